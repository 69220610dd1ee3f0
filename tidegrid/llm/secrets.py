"""Secrets in texts: fixed patterns and a battery of randomness tests, in DataFrame operations only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.store import cut

#: Fixed patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the randomness tests look at.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings by name: the characters that a token may have and their order; the first that fits counts.
ALPHABETS = {
    "digits": ("^[0-9]+$", "0123456789"),
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "hex_upper": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "lower": ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "upper": ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "letters": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base64": ("^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    "base64url": ("^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
}
_BLOCK = 128
#: Tokens of more characters are tested in so many equal pieces that none is longer.
_PIECE = 512
_GRID = (0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
#: Lower ends of the classes of length that share a limit.
_LENGTHS = (20, 24, 28, 32, 40, 48, 64)


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once: an expression inside a lambda would be worked out again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, match>> of all non-overlapping matches from the left, in code points.

    Matches and the texts between them come from two passes of the same pattern; starts are sums of their lengths, added
    up in blocks so that many matches in one text do not cost the square of their number.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x.g + x.m)
    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("match"))), 1, 0)

    def place(block: Column, begin: Column) -> Column:
        start = lambda x, i: begin + total(F.slice(block, F.lit(1), i)) + x.g
        return F.transform(block, lambda x, i: _let(start(x, i), lambda at: F.struct(at.alias("start"), (at + x.m).alias("stop"), x.match.alias("match"))))

    def in_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, total)
        begins = _let(sums, lambda s: F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, x: a + x)))
        return F.flatten(F.zip_with(blocks, begins, place))

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), F.char_length(m).alias("m"), m.alias("match")))
        last = F.floor((F.size(found) - 1) / _BLOCK).cast("int")
        blocks = _let(rows, lambda r: F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(r, k * _BLOCK + 1, F.lit(_BLOCK))))
        return F.when(F.size(found) == 0, none).otherwise(_let(blocks, in_blocks))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _phi_upper(z: Column) -> Column:
    """P(Z > z) of a normal variable (Abramowitz and Stegun 26.2.17; error below 1e-7)."""
    x = F.least(F.abs(z), F.lit(38.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _by_alphabet(name: Column, f) -> Column:
    return F.coalesce(*[F.when(name == k, f(a)) for k, (_, a) in ALPHABETS.items()])


def battery(token: Column) -> Column:
    """struct<encoding, n, p>: the probability that a uniformly random token of the inferred encoding looks less random.

    Three tests: chi-squared of the characters' frequencies (Wilson-Hilferty), runs above and below the middle of the alphabet,
    serial correlation of neighbours. Their probabilities are combined by Fisher's method (chi-squared of 6 degrees of freedom),
    and so are those of a long token's pieces (2 degrees for each, by Wilson-Hilferty).
    """
    sum_ = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    pairs = lambda xs, f: F.zip_with(F.slice(xs, F.lit(2), F.size(xs) - 1), F.slice(xs, F.lit(1), F.size(xs) - 1), f)
    log_p = lambda p: F.log(F.greatest(p, F.lit(1e-12)))

    def tests(size: Column, codes: Column) -> Column:
        n = F.size(codes).cast("double")
        df = size - 1
        squares = sum_(F.transform(F.array_distinct(codes), lambda c: F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), F.lit(2.0))))
        z1 = (F.pow(F.greatest(squares * size / n - n, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        sides = F.transform(codes, lambda c: (c > size / 2).cast("double"))
        z2 = _let(sides, lambda s: _let(F.struct((2 * sum_(s) * (n - sum_(s))).alias("both"), (1 + sum_(pairs(s, lambda x, y: F.abs(x - y)))).alias("runs")),
                  lambda r: F.when(r.both > 0, (r.runs - r.both / n - 1) / F.sqrt(F.greatest(r.both * (r.both - n) / (n * n * (n - 1)), F.lit(1e-9)))).otherwise(F.lit(9.0))))
        z3 = _let(F.transform(F.array(sum_(codes) / n), lambda mean: F.transform(codes, lambda c: c - mean))[0],
                  lambda d: _let(sum_(F.transform(d, lambda x: x * x)), lambda v: F.when(v > 0, sum_(pairs(d, lambda x, y: x * y)) / v * F.sqrt(n)).otherwise(F.lit(9.0))))
        half = _let(F.struct(z1.alias("a"), F.abs(z2).alias("b"), F.abs(z3).alias("c")), lambda z: -(log_p(_phi_upper(z.a)) + log_p(2 * _phi_upper(z.b)) + log_p(2 * _phi_upper(z.c))))
        p = _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))
        return p

    def in_pieces(encoding: Column, size: Column, codes: Column) -> Column:
        n = F.size(codes).cast("long")
        k = F.ceil(n / _PIECE)
        edge = lambda i: F.floor(i * n / k).cast("int")
        ps = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: _let(F.slice(codes, edge(i) + 1, edge(i + 1) - edge(i)), lambda c: tests(size, c)))
        joint = lambda x: _phi_upper((F.pow(-sum_(F.transform(x, log_p)) / k, F.lit(1 / 3)) - (1 - 1 / (9.0 * k))) / F.sqrt(1 / (9.0 * k)))
        p = F.when(k <= 1, tests(size, codes)).otherwise(_let(ps, joint))
        return F.struct(encoding.alias("encoding"), n.cast("int").alias("n"), p.alias("p"))

    name = F.coalesce(*[F.when(token.rlike(rx), F.lit(k)) for k, (rx, _) in ALPHABETS.items()], F.lit("base64"))
    letters = F.split(F.regexp_replace(token, "=+$", ""), "(?!^)")
    return _let(
        name,
        lambda e: _let(
            _by_alphabet(e, lambda a: F.lit(a)),
            lambda alphabet: _let(F.transform(letters, lambda c: F.instr(alphabet, c).cast("double")), lambda codes: in_pieces(e, F.char_length(alphabet).cast("double"), codes)),
        ),
    )


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with ``base`` (array of start, kind number, stop) and ``tests`` (array of start, stop, encoding, n, p)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda kind: lambda x: F.struct(x.start.alias("start"), F.lit(kind).alias("kind"), x.stop.alias("stop"))
    assign = F.filter(_places(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x.match, ASSIGN, 2)) >= 8)
    base = F.concat(F.transform(assign, span(0)), F.transform(_places(text, ACCESS), span(1)), F.transform(_places(text, HEX), span(2)))
    out = docs.withColumn("base", F.array_sort(base)).withColumn("tokens", _places(text, TOKEN))
    tests = F.transform("tokens", lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop"), battery(x.match).alias("t")))
    return out.withColumn("tests", F.transform(tests, lambda x: F.struct(x.start, x.stop, x.t.encoding.alias("encoding"), x.t.n.alias("n"), x.t.p.alias("p")))).drop("tokens")


def _length_class(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= k, F.lit(k)) for k in reversed(_LENGTHS)], F.lit(_LENGTHS[0]))


def limits(scanned: DataFrame, rate: float = 0.05) -> dict[tuple[str, int], float]:
    """The least p to accept for each encoding and class of length, so that at most ``rate`` of what is accepted is not random.

    p is uniform for random tokens and near 0 for others, the more surely the longer they are. So twice the tokens with p
    above 1/2 estimates the random ones, and what passes a limit beyond their expected share is false. One aggregation
    of at most encodings x classes rows; a class that never meets the rate accepts nothing.
    """
    t = scanned.select(F.explode("tests").alias("t")).select("t.encoding", _length_class(F.col("t.n")).alias("class"), "t.p")
    counts = t.groupBy("encoding", "class").agg(*[F.sum((F.col("p") >= g).cast("long")).alias(f"g{i}") for i, g in enumerate(_GRID)])
    out = {}
    for r in counts.collect():
        random = 2 * r[f"g{len(_GRID) - 1}"]
        for i, g in enumerate(_GRID):
            passed = r[f"g{i}"]
            if passed and 1 - min(1.0, random * (1 - g) / passed) <= rate:
                out[r.encoding, r["class"]] = g
                break
    return out


def with_spans(scanned: DataFrame, limit: dict[tuple[str, int], float]) -> DataFrame:
    """scanned with ``all`` (array of start, kind number, stop): base spans and tokens that pass the limits, by start, then kind."""
    least = lambda t: F.coalesce(*[F.when((t.encoding == e) & (_length_class(t.n) == c), F.lit(p)) for (e, c), p in sorted(limit.items())], F.lit(2.0))
    random = F.transform(F.filter("tests", lambda t: t.p >= least(t)), lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("kind"), t.stop.alias("stop")))
    return scanned.withColumn("all", F.array_sort(F.concat("base", random)))


def spelled(spans: Column) -> Column:
    """kind:start:stop, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.kind), x.start.cast("string"), x.stop.cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans): secrets of every whole text.

    Kinds: ``assign`` (a name such as password, a sign and a value of 8 or more characters), ``access`` (key ids of 16 or more),
    ``hex`` (32 or more digits), ``random`` (tokens of 20 or more characters that pass the randomness tests).
    Spans are of whole matches, in code points, the end exclusive; kinds may overlap. base_sha256 hashes the first three kinds'
    spans. Null and empty texts have none. Ids are not read; an empty table gives no rows.
    """
    rows = cut(scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text"), "secrets")
    out = with_spans(rows, limits(rows, rate))
    count = lambda k: F.size(F.filter("all", lambda x: x.kind == k)).cast("long")
    return out.select("id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """docs with every span of find() in the text replaced by ``mask`` (overlapping spans by one); null texts stay null."""
    tests = cut(scan(docs.select(F.col(text_col).alias("text")), "text").select("tests").where(F.size("tests") > 0), "tests")
    limit = limits(tests, rate)
    names = [c for c in docs.columns]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = with_spans(scan(inner, "text"), limit)
    text = F.when(F.size("all") > 0, _masked(F.col("text"), F.col("all"), mask)).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` in place of each span, of overlapping ones once.

    Spans are sorted by start; each adds what stands between it and the farthest end before it. They go in blocks, each of
    which cuts its own part out of the text first, so that many spans in a long text do not cost their number times its length.
    """
    last = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: x.stop)), F.lit(0))

    def in_block(begin: Column, block: Column) -> Column:
        part = F.substring(text, begin + 1, F.element_at(block, -1).start - begin)
        at = lambda i: F.greatest(begin, last(F.slice(block, F.lit(1), i)))
        cut_ = lambda p, x, a: F.when(x.start >= a, F.concat(F.substring(p, a - begin + 1, x.start - a), F.lit(mask))).otherwise(F.lit(""))
        return _let(part, lambda p: F.array_join(F.transform(block, lambda x, i: _let(at(i), lambda a: cut_(p, x, a))), ""))

    n = F.floor((F.size(spans) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(spans, k * _BLOCK + 1, F.lit(_BLOCK)))

    def joined(b: Column) -> Column:
        ends = F.transform(b, last)
        begins = _let(ends, lambda e: F.transform(e, lambda _, i: F.coalesce(F.array_max(F.slice(e, F.lit(1), i)), F.lit(0))))
        rest = F.substring(text, last(spans) + 1, F.char_length(text))
        return F.concat(F.array_join(F.zip_with(begins, b, in_block), ""), rest)

    return _let(blocks, joined)
