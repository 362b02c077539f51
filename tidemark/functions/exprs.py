"""Column functions: timestamps of mixed precision, paths, file classes, compression, texts, errors.

"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGACY_LIMIT = 1_000_000_000_000
NANOS = 1_000_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time (B24-B26, H37, H38)


def is_legacy(x) -> Column:
    """The value counts seconds, not nanoseconds."""
    return F.abs(col(x)) < F.lit(LEGACY_LIMIT)


def whole_seconds(x) -> Column:
    """Seconds of either precision, rounded down; whole-number arithmetic throughout."""
    x = col(x)
    rest = F.pmod(x, F.lit(NANOS).cast("long"))
    return F.when(is_legacy(x), x).otherwise(((x - rest).cast("decimal(38,0)") / F.lit(NANOS).cast("decimal(10,0)")).cast("long"))


def unix_nanos(ts) -> Column:
    """Nanoseconds since 1970, never negative."""
    return F.greatest(F.unix_micros(col(ts)) * 1000, F.lit(0).cast("long"))


def ts_match(a, b) -> Column:
    """Equal, or equal in whole seconds where either side has only those."""
    a, b = col(a), col(b)
    return F.when(a == b, True).when(is_legacy(a) | is_legacy(b), whole_seconds(a) == whole_seconds(b)).otherwise(False)


def optional_ts_match(a, b) -> Column:
    """As ``ts_match``; two nulls are equal, one is not."""
    a, b = col(a), col(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(ts_match(a, b))


# --- paths


def normalized_path(p) -> Column:
    """Without ``.``, with ``..`` taking the part before it; an absolute path stays absolute (H3)."""
    p = col(p)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.when(F.startswith(p, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def ancestors(p) -> Column:
    """All proper ancestors of a path, from the top."""
    parts = F.split(col(p), "/")
    n = F.size(parts) - 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def parent_path(p) -> Column:
    """The path without its last part; ``.`` where there is none (H8)."""
    q = F.regexp_replace(col(p), "/+$", "")
    head = F.regexp_extract(q, "^(.*)/[^/]*$", 1)
    return F.when(~F.contains(q, F.lit("/")), F.lit(".")).when(head == "", F.lit("/")).otherwise(head)


def strip_prefix(p, prefix) -> Column:
    """The rest after a prefix of whole parts, null where it is none."""
    p, prefix = col(p), col(prefix)
    return F.when(p == prefix, F.lit("")).when(F.startswith(p, F.concat(prefix, F.lit("/"))), F.substring(p, F.length(prefix) + 2, F.length(p)))


def relative_path(p, root) -> Column:
    """Path below a root given as plain text; the whole path where the text does not match (H5)."""
    p, root = col(p), col(root)
    return F.when(F.startswith(p, root), F.ltrim(F.substring(p, F.length(root) + 1, F.length(p)), F.lit("/"))).otherwise(p)


def join_path(base, rest) -> Column:
    return F.concat(F.rtrim(col(base), F.lit("/")), F.lit("/"), col(rest))


def valid_path(p) -> Column:
    """No NUL and no ``..`` part."""
    p = col(p)
    return ~F.contains(p, F.lit("\0")) & ~F.exists(F.split(p, "/"), lambda x: x == "..")


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns], F.lit(False))


def excluded(p, patterns: list[str]) -> Column:
    """Any pattern occurs in the path."""
    return any_match(col(p), patterns)


def included(p, patterns: list[str]) -> Column:
    """True without patterns, else any occurs."""
    return any_match(col(p), patterns) if patterns else F.lit(True)


def file_kept(p, include: list[str], exclude: list[str]) -> Column:
    """Kept by the filters, and below no excluded directory, which a scan would not enter."""
    hidden = F.exists(ancestors(p), lambda a: any_match(a, exclude)) if exclude else F.lit(False)
    return ~excluded(p, exclude) & included(p, include) & ~hidden


def final_id(job_id) -> Column:
    return F.concat(col(job_id), F.lit("_final"))


def is_public(job_id) -> Column:
    """Not the internal final round of a job."""
    return ~F.endswith(col(job_id), F.lit("_final"))


# --- file classes and compression

#: Classes by extension: fixed values.
EXTENSIONS = {
    "Log": ["log"],
    "StructuredText": ["json", "xml", "html", "htm", "svg"],
    "Config": ["yaml", "yml", "toml", "conf", "config", "ini"],
    "Code": ["rs", "go", "java", "c", "cpp", "h", "hpp", "py", "js", "ts", "jsx", "tsx", "php", "rb", "sh", "bash", "ps1", "sql", "css", "scss", "less"],
    "PlainText": ["txt", "md", "csv", "tsv", "rtf"],
    "Database": ["db", "sqlite", "sqlite3", "mdb"],
    "Image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "ico", "tiff", "tif"],
    "Video": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v", "mpeg", "mpg"],
    "Audio": ["mp3", "aac", "ogg", "wav", "flac", "m4a", "wma"],
    "Archive": ["zip", "gz", "tar", "bz2", "xz", "7z", "rar", "zst", "lz4"],
    "Executable": ["exe", "dll", "so", "dylib", "bin"],
    "SimulationResult": ["cas", "dat", "msh", "odb", "fil", "inp", "foam", "plt", "szplt", "bdf", "op2", "f06"],
    "ScientificData": ["h5", "hdf5", "hdf", "nc", "nc4", "vtk", "vtu", "vtp", "pvd"],
}
#: Names that begin so are simulation results: fixed values.
SIMULATION_NAMES = ["d3plot", "d3dump", "d3thdt", "d3eigv", "binout"]
#: First bytes by class: fixed values.
MAGIC = {"Image": ["89504E47", "FFD8FF", "47494638"], "Archive": ["504B0304", "1F8B", "425A68"]}
NOT_COMPRESSIBLE = ["Image", "Video", "Audio", "Archive"]
#: Algorithm and expected ratio by class: fixed values; all others zstd, or none and 1.0.
ALGORITHMS = {"Log": "lz4", "Database": "lz4", "StructuredText": "brotli", "Config": "brotli"}
RATIOS = {"Log": 0.15, "StructuredText": 0.20, "Config": 0.25, "Code": 0.30, "PlainText": 0.35, "Database": 0.50, "Executable": 0.60, "SimulationResult": 0.70, "ScientificData": 0.65, "Unknown": 0.70}
MIN_COMPRESS, MAX_COMPRESS = 1024, 100 * 1024 * 1024
#: Media types by file ending: fixed values.
MIME = {".html": "text/html", ".css": "text/css", ".js": "application/javascript", ".wasm": "application/wasm", ".json": "application/json", ".png": "image/png", ".svg": "image/svg+xml"}


def chain(cases, default) -> Column:
    """``CASE WHEN`` over (condition, value) pairs, in order."""
    out = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def mime_type(p) -> Column:
    return chain([(F.endswith(col(p), F.lit(end)), kind) for end, kind in MIME.items()], "application/octet-stream")


def class_by_name(p) -> Column:
    """By the name's start, then by what follows its last dot, unless that dot is its first character."""
    name = F.lower(F.regexp_extract(col(p), "([^/]*)$", 1))
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    sim = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(s)) for s in SIMULATION_NAMES])
    known = F.create_map(*(F.lit(x) for c, some in EXTENSIONS.items() for e in some for x in (e, c)))
    return F.when(sim, F.lit("SimulationResult")).otherwise(F.coalesce(F.try_element_at(known, ext), F.lit("Unknown")))


def class_by_magic(content) -> Column:
    """By the first bytes; fewer than four are of no class."""
    head = F.hex(F.substring(col(content), 1, 4))
    hits = [(F.startswith(head, F.lit(m)), c) for c, some in MAGIC.items() for m in some]
    return F.when(F.length(col(content)) < 4, F.lit("Unknown")).otherwise(chain(hits, "Unknown"))


def file_class(p, content=None) -> Column:
    """By name, and by content where the name says nothing."""
    by_name = class_by_name(p)
    return by_name if content is None else F.when(by_name != "Unknown", by_name).otherwise(F.coalesce(class_by_magic(content), F.lit("Unknown")))


def by_class(values: dict, cls, default) -> Column:
    """The value listed for a class: one look-up in a literal map."""
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(known, col(cls)), F.lit(default))


def compressible(cls) -> Column:
    return ~col(cls).isin(NOT_COMPRESSIBLE)


def algorithm(cls) -> Column:
    return chain([(~compressible(cls), "none"), *((col(cls) == c, a) for c, a in ALGORITHMS.items())], "zstd")


def expected_ratio(cls) -> Column:
    return by_class(RATIOS, cls, 1.0)


def compression_decision(p, size, cls=None) -> Column:
    """struct(should_compress, file_type, estimated_ratio, reason) by size, then by class."""
    size, cls = col(size), class_by_name(p) if cls is None else col(cls)

    def decision(yes, kind, ratio, reason):
        return F.struct(yes.alias("should_compress"), kind.alias("file_type"), ratio.alias("estimated_ratio"), reason.alias("reason"))

    no = F.lit(False), F.lit("Unknown"), F.lit(1.0)
    small = F.concat(F.lit("File too small: "), size.cast("string"), F.lit(f" bytes < {MIN_COMPRESS} bytes"))
    large = F.concat(F.lit("File too large: "), size.cast("string"), F.lit(f" bytes > {MAX_COMPRESS} bytes"))
    ok = compressible(cls)
    why = F.concat(F.lit("File type "), cls, F.when(ok, F.lit(" is compressible")).otherwise(F.lit(" is already compressed")))
    return F.when(size < MIN_COMPRESS, decision(*no, small)).when(size > MAX_COMPRESS, decision(*no, large)).otherwise(decision(ok, cls, expected_ratio(cls), why))


#: Levels of fastest, balanced, best, and the range of custom ones: fixed values.
LEVELS = {"zstd": (1, 3, 10, 1, 22), "brotli": (4, 6, 11, 0, 11), "lz4": (1, 6, 12, 1, 16)}


def compression_level(kind: str, name, custom=None) -> Column:
    fastest, balanced, best, low, high = LEVELS[kind]
    own = F.greatest(F.lit(low), F.least(F.lit(high), col(custom))) if custom is not None else F.lit(balanced)
    return chain([(col(name) == "fastest", fastest), (col(name) == "best", best), (col(name) == "custom", own)], balanced)


# --- numbers as text and as classes


def scaled_text(n, bits: int, digits: int) -> Column:
    """``n / 2**bits`` with so many decimals, ties to the even digit, in whole numbers throughout."""
    unit, scale = 1 << bits, 10**digits
    part = n.bitwiseAND(F.lit(unit - 1).cast("long")) * F.lit(scale)
    down = F.shiftright(n, bits) * F.lit(scale) + F.shiftright(part, bits)
    left = part.bitwiseAND(F.lit(unit - 1).cast("long")) * 2
    up = (left > unit) | ((left == unit) & (down % 2 == 1))
    value = down + up.cast("long")
    if not digits:
        return value.cast("string")
    return F.concat(F.floor(value / F.lit(scale)).cast("long").cast("string"), F.lit("."), F.lpad((value % scale).cast("string"), digits, "0"))


def human_bytes(n) -> Column:
    """B, KB without, MB with one, GB with two decimals, of 1024 each."""
    n = col(n).cast("long")
    return (
        F.when(n >= 1024**3, F.concat(scaled_text(n, 30, 2), F.lit(" GB")))
        .when(n >= 1024**2, F.concat(scaled_text(n, 20, 1), F.lit(" MB")))
        .when(n >= 1024, F.concat(scaled_text(n, 10, 0), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def duration_text(seconds) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``."""
    s = col(seconds).cast("long")
    whole = lambda n: F.floor(s / F.lit(n)).cast("long").cast("string")
    rest = lambda n, m: F.floor((s % F.lit(n)) / F.lit(m)).cast("long").cast("string")
    return (
        F.when(s >= 3600, F.concat(whole(3600), F.lit("h "), rest(3600, 60), F.lit("m")))
        .when(s >= 60, F.concat(whole(60), F.lit("m "), rest(60, 1), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def duration_label(start, end, status) -> Column:
    """Queued, Paused, or the duration; ``now`` is the caller's end for jobs that still run."""
    gap = F.abs(F.unix_micros(col(end)) - F.unix_micros(col(start)))
    return (
        F.when(col(status) == "pending", F.lit("Queued"))
        .when(col(status) == "paused", F.lit("Paused"))
        .when(col(start).isNull() | col(end).isNull(), F.lit("-"))
        .otherwise(duration_text(F.floor(gap / F.lit(1_000_000))))
    )


def datetime_text(text) -> Column:
    """RFC 3339 text as date and time without the fraction; ``-`` for an empty one."""
    t = col(text)
    time = F.split_part(F.substring(t, F.locate("T", t) + 1, F.length(t)), F.lit("."), F.lit(1))
    return F.when(t == "", F.lit("-")).when(F.locate("T", t) == 0, t).otherwise(F.concat(F.substring_index(t, "T", 1), F.lit(" "), time))


def round_badge(job_type, round_id, last) -> Column:
    """``Round n`` or ``Final Round n`` for sync jobs, null for others."""
    n = F.concat(F.lit("Round "), col(round_id).cast("string"))
    return F.when(col(job_type) == "sync", F.when(col(last), F.concat(F.lit("Final "), n)).otherwise(n))


def percent(done, total) -> Column:
    """Whole percent of the clamped part, 0 without a total."""
    done, total = col(done), col(total)
    return F.when(total > 0, F.floor(F.least(done, total).cast("double") / total.cast("double") * 100.0).cast("int")).otherwise(F.lit(0))


def gap_or_zero(a, b) -> Column:
    return F.greatest(col(a) - col(b), F.lit(0).cast("long"))


def megabits(n_bytes, seconds) -> Column:
    return F.when(col(seconds) > 0, col(n_bytes) * 8.0 / col(seconds) / 1e6).otherwise(F.lit(0.0))


def network_quality(mbps) -> Column:
    m = col(mbps)
    return chain([(m >= 800, "Excellent"), (m >= 200, "Good"), (m >= 50, "Fair"), (m > 0, "Poor")], "Unknown")


def initial_concurrency(quality) -> Column:
    q = col(quality)
    return chain([(q == "Excellent", 64), (q == "Good", 32), (q == "Fair", 16), (q == "Poor", 4)], 8)


def stream_budget(is_quic, requested, files) -> Column:
    """Streams a file may use, at least one."""
    share = F.floor(F.lit(64) / F.greatest(col(files), F.lit(1))).cast("int")
    return F.greatest(F.when(col(is_quic), col(requested)).otherwise(F.least(col(requested), share)), F.lit(1))


def operation_timeout(base_s, rtt_ms, factor) -> Column:
    return F.least(F.lit(300.0), F.greatest(F.lit(5.0), col(base_s) * F.greatest(col(rtt_ms) / 50.0, F.lit(1.0)) * col(factor)))


#: Chunk size in MiB, streams and seconds of idleness by quality: this engine's own presets.
PRESETS = {"Excellent": (8, 64, 300), "Good": (4, 32, 180), "Fair": (2, 16, 120), "Poor": (1, 4, 60)}


def tuning(quality) -> Column:
    """struct(chunk_mib, streams, idle_s); an unknown quality is tuned as a poor one."""
    at = lambda v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("chunk_mib", "streams", "idle_s"))))
    return chain([(col(quality) == q, at(v)) for q, v in PRESETS.items() if q != "Poor"], at(PRESETS["Poor"]))


def kept_progress(current, total, before) -> Column:
    """Whole percent of at most 100; without a total the value before stays."""
    current, total = col(current), col(total)
    return F.when(total > 0, F.least(F.floor(current.cast("double") / total.cast("double") * 100.0), F.lit(100)).cast("int")).otherwise(col(before))


def is_loopback(bind) -> Column:
    """The address, with or without a port, is this machine's own."""
    b = col(bind)
    return b.rlike(r"^127(\.\d{1,3}){3}:\d+$") | b.rlike(r"^\[::1\]:\d+$") | F.regexp_replace(F.split_part(b, F.lit(":"), F.lit(1)), r"^\[+|\]+$", "").isin("127.0.0.1", "localhost")


def rfc3339(text) -> Column:
    """The time of an RFC 3339 text; null stays null, any other text fails the query."""
    t = col(text)
    ok = t.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    at = F.try_to_timestamp(F.upper(t))
    return F.when(t.isNull(), None).when(ok & at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("invalid time: "), t)).cast("timestamp"))


def size_priority(size) -> Column:
    mib = 1024 * 1024
    return chain([(col(size) <= mib, "High"), (col(size) <= 10 * mib, "Normal"), (col(size) <= 100 * mib, "Low")], "Background")


def backoff_ms(attempt) -> Column:
    return F.least(F.lit(100.0) * F.pow(F.lit(2.0), col(attempt)), F.lit(10_000.0)).cast("long")


#: Minutes to the next try by the tries so far: fixed values.
RETRY_MINUTES = [1, 3, 6, 10]


def retry_minutes(count) -> Column:
    return chain([(col(count) <= k, m) for k, m in enumerate(RETRY_MINUTES[:-1])], RETRY_MINUTES[-1])


# --- errors

#: Texts of errors worth another try: fixed values.
RETRIABLE = ["not connected to server", "connection refused", "connection reset", "broken pipe", "connection aborted", "network is unreachable", "no route to host", "unhealthy"]
RETRIABLE_KINDS = ["ConnectionError", "NetworkError", "Io", "QuicConnection", "QuicWrite", "QuicRead"]
FATAL_KINDS = ["ProtocolError", "SerializationError", "InvalidProtocol", "InvalidConfig"]
CATEGORY_RANK = {"Fatal": 4, "Transient": 3, "Retriable": 2, "Unknown": 1}


def error_category(message, kind) -> Column:
    """By the text, then by the kind of error."""
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(F.lower(col(message)), F.lit(x)) for x in xs])
    return chain(
        [
            (has("[fatal]"), "Fatal"),
            (has("timeout", "timed out"), "Transient"),
            (has(*RETRIABLE), "Retriable"),
            (col(kind).isin(RETRIABLE_KINDS), "Retriable"),
            (col(kind).isin(FATAL_KINDS), "Fatal"),
            ((col(kind) == "FileOperation") & has("not found", "permission denied"), "Fatal"),
            (col(kind) == "FileOperation", "Retriable"),
        ],
        "Unknown",
    )


def is_cancelled(message) -> Column:
    return F.contains(col(message), F.lit("cancelled by user")) | (col(message) == "job cancelled")


def category_rank(category) -> Column:
    return chain([(col(category) == c, r) for c, r in CATEGORY_RANK.items()], 1)
