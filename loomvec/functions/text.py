"""Content addresses and name grammars, as driver functions and as column expressions that agree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 namespace for object identifiers: a fixed value.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def text_hash(text: str | Column) -> Column:
    """Hexadecimal MD5 of the UTF-8 text."""
    return F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def point_id(hash_: str | Column) -> Column:
    """Version-5 UUID of a text hash in the OID namespace, as a native expression."""
    h = F.col(hash_) if isinstance(hash_, str) else hash_
    s = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_OID)), F.encode(h, "UTF-8")))
    variant = F.translate(F.substring(s, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(s, 1, 8), F.lit("-"), F.substring(s, 9, 4), F.lit("-5"), F.substring(s, 14, 3), F.lit("-"), variant, F.substring(s, 18, 3), F.lit("-"), F.substring(s, 21, 12))


@dataclass(frozen=True)
class Model:
    provider: str
    name: str

    def __str__(self) -> str:
        return f"{self.provider}/{self.name}"


def parse_model(model: str) -> Model:
    """``provider/name``; the name may hold more slashes."""
    provider, slash, name = model.partition("/")
    if not slash:
        raise ValueError(f"model {model!r} must look like provider/name")
    return Model(provider, name)


def model_columns(model: str | Column) -> tuple[Column, Column]:
    """(provider, name) of a model column; null where it has no slash."""
    m = F.col(model) if isinstance(model, str) else model
    at = F.instr(m, "/")
    return F.when(at > 0, F.substring_index(m, "/", 1)), F.when(at > 0, F.substr(m, at + 1))


@dataclass(frozen=True)
class SinkUri:
    """``scheme://host:port/collection`` with query parameters; ``file:///folder/collection`` keeps its whole path."""

    uri: str
    scheme: str
    host: str
    port: int
    collection: str
    path: str
    params: tuple[tuple[str, str], ...]


def parse_sink(uri: str, default_port: int = 6333) -> SinkUri:
    u = urlsplit(uri)
    name = u.path.strip("/").rsplit("/", 1)[-1] if u.scheme == "file" else u.path.strip("/")
    return SinkUri(uri, u.scheme, u.hostname or "localhost", u.port or default_port, name, u.path, tuple(parse_qsl(u.query)))


def sink_columns(uri: str | Column, default_port: int = 6333) -> tuple[Column, Column, Column, Column]:
    """(scheme, host, port, collection) of a column of sink URIs."""
    u = F.col(uri) if isinstance(uri, str) else uri
    part = lambda n: F.regexp_extract(u, r"^([a-z]+)://([^:/?]*)(?::([0-9]+))?/?([^?]*)", n)
    filled = lambda c, other: F.when(c == "", F.lit(other)).otherwise(c)
    return part(1), filled(part(2), "localhost"), filled(part(3), str(default_port)).cast("int"), part(4)


def v2_uri(uri: str) -> str:
    """The same sink with ``_v2`` after its collection's name."""
    u = urlsplit(uri)
    return urlunsplit(u._replace(path=u.path.rstrip("/") + "_v2"))


def v2_column(uri: str | Column) -> Column:
    u = F.col(uri) if isinstance(uri, str) else uri
    return F.regexp_replace(u, r"^([^?]*?)/?(\?.*)?$", "$1_v2$2")


def postgres_target(uri: str) -> tuple[str, str]:
    """(connection URI, table): the ``table`` parameter (default ``embeddings``) taken out and checked as an identifier."""
    u = urlsplit(uri)
    params = dict(parse_qsl(u.query))
    table = params.pop("table", "embeddings")
    if not IDENTIFIER.fullmatch(table):
        raise ValueError(f"table name {table!r} is not a plain identifier")
    return urlunsplit(u._replace(scheme="postgresql", query=urlencode(params))), table
