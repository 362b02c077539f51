"""Request texts: idempotency keys, tokens, canonical fingerprints, destinations, patterns."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as E


def idempotency_key(value) -> Column:
    """The trimmed key; null where it is empty or longer than 255 bytes."""
    key = F.trim(E.col(value))
    return F.when((key != "") & (F.octet_length(key) <= 255), key)


def bearer_token(value) -> Column:
    """The token of exactly two words of which the first is ``bearer`` in any case."""
    parts = F.filter(F.split(E.col(value), r"\s+"), lambda x: x != "")
    return F.when((F.size(parts) == 2) & (F.lower(F.get(parts, F.lit(0))) == "bearer"), F.get(parts, F.lit(1)))


def canonical_patterns(patterns) -> Column:
    """Sorted, without repeats."""
    return F.array_sort(F.array_distinct(E.col(patterns)))


def request_fingerprint(source, dest, job_type, exclude, include) -> Column:
    """SHA-256 of the request in one canonical form: paths normalised, pattern lists canonical, fields in a
    fixed order, each preceded by its length so that no two requests read alike (H2)."""
    one = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    many = lambda c: F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(F.transform(c, one), ""), F.lit("]"))
    parts = [one(E.normalized_path(source)), one(E.normalized_path(dest)), one(E.col(job_type)), many(canonical_patterns(exclude)), many(canonical_patterns(include))]
    return F.sha2(F.concat(*parts), 256)


def destination(base, relative, files, dest_is_file: bool = False) -> Column:
    """Where a file goes: below the base, or, for a single file and a base without a closing slash, the base
    itself (H6)."""
    alone = (E.col(files) == 1) & ~F.endswith(E.col(base), F.lit("/"))
    return F.when(alone, E.col(base)).otherwise(E.join_path(base, relative))


def confined(path, root, external: bool = False) -> Column:
    """The normalised path below ``root``; a path outside fails the query unless that is allowed (H7)."""
    p = E.normalized_path(F.when(F.startswith(E.col(path), F.lit("/")), E.col(path)).otherwise(E.join_path(root, path)))
    inside = E.strip_prefix(p, root).isNotNull()
    return p if external else F.when(inside, p).otherwise(F.raise_error(F.concat(F.lit("destination outside the data directory: "), p)))


def relative_strict(path, root) -> Column:
    """Path below a root of whole parts; ``..`` or another root fails the query (H4)."""
    ok = E.valid_path(path) & E.strip_prefix(path, root).isNotNull()
    return F.when(ok, E.strip_prefix(path, root)).otherwise(F.raise_error(F.concat(F.lit("not below the root: "), E.col(path))))


def check_patterns(patterns: list[str]) -> list[str]:
    """The patterns, if all compile and use neither look-around nor back-references."""
    for p in patterns:
        if re.search(r"\(\?(=|!|<=|<!)|\\[1-9]|\(\?P=", p):
            raise ValueError(f"look-around and back-references are not supported: {p}")
        re.compile(p)
    return patterns
