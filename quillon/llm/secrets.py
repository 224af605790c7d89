"""Secret scans by patterns and by a battery of randomness tests, in DataFrame functions only.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of their
patterns; short ones are dropped after matching. The battery looks at the runs
of `least` (20) and more characters of encodings that no base span overlaps: the
encoding is inferred from the characters (hexadecimal, base 32, base 36, base
62, base 64), and under the hypothesis of uniform random symbols of that
alphabet it tests the symbol counts (chi-squared), the runs above and below the
middle, and the correlation of neighbours. The three are combined by Fisher's
method into one value: how far a token is from random.

What is reported is controlled against identifiers. Decoys are made of every
document: its words joined as names are (candidates left out, words begun with
capitals where an encoding has both cases), of which `pieces` pieces spread over
the whole text, ended by a digit, have the least length of the tokens' length
class (so that they look more random than longer ones would). A token's
p-value is the share of its encoding's and class's decoys that look as random.
Benjamini and Hochberg's procedure within each length class (long tokens have
power that short ones lack) then holds the share of false secrets among the
reported, of kind `random`, at `level`. Both distributions are histograms of a
fixed number of bins whatever the corpus.

Offsets are in code points, the end exclusive. Null texts are as empty ones: no
spans, and the hash of the empty string. Rows are scanned one by one, repeated
or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the whole run is taken at its first character, so that the length may stand in the pattern
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
LEVEL, LEAST, PIECES, BINS_A_NAT, MAX_NATS = 0.05, 20, 4, 20, 60
#: Matches of a document that are placed together.
_CHUNK = 256
#: Name, pattern of the whole token, symbols in order of value.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (s, kind, e, token): the matches whose group has at least so many characters, in order."""
    p = F.lit(pattern)
    gaps, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), part, lambda x, t: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), t.alias("token")))
    empty = F.array().cast("array<struct<s:int,kind:int,e:int,token:string>>")

    def step(acc, x):
        s = acc["at"] + x["gap"]
        span = F.struct(s.alias("s"), F.lit(kind).alias("kind"), (s + x["len"]).alias("e"), x["token"].alias("token"))
        return F.struct((s + x["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunked(steps):
        """Chunks of matches, each begun where the ones before it end: arrays that grow are short ones."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")), lambda i: F.slice(steps, i * _CHUNK + 1, F.lit(_CHUNK)))
        return _let(chunks, placed)

    def placed(chunks):
        long = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"]))
        starts = F.aggregate(long, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, at: F.aggregate(c, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    all_ = F.when(F.size(steps) > 0, _let(steps, chunked)).otherwise(empty)
    return F.when(text.rlike(pattern), F.filter(all_, lambda x: F.length(x["token"]) >= least)).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(N > z), Zelen and Severo's polynomial (error below 1e-7), kept above 1e-30."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-30))


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def battery(token: Column, symbols: Column) -> Column:
    """Combined p-value of token's being uniform random symbols."""
    m = F.length(symbols).cast("double")
    chars = F.filter(F.split(F.rtrim(token, F.lit("=")), ""), lambda c: c != "")
    values = F.transform(chars, lambda c: (F.instr(symbols, c) - 1).cast("double"))
    add = lambda a, x: a + x

    def sums(v: Column) -> Column:
        neighbours = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        n = F.size(v).cast("double")
        return F.struct(v.alias("v"), neighbours.alias("pairs"), n.alias("n"), (F.aggregate(v, F.lit(0.0), add) / n).alias("mean"))

    def deviates(x: Column) -> Column:
        """chi, runs and serial as standard normal deviates under randomness; null where there is no spread."""
        v, pairs, n, mean = x["v"], x["pairs"], x["n"], x["mean"]
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter(v, lambda c: c == d)).cast("double"), 2.0))
        n1 = F.aggregate(v, F.lit(0.0), lambda a, c: a + (c >= m / 2).cast("double"))
        runs = F.aggregate(pairs, F.lit(1.0), lambda a, c: a + ((c["a"] >= m / 2) != (c["b"] >= m / 2)).cast("double"))
        spread = F.aggregate(v, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, c: a + (c["a"] - mean) * (c["b"] - mean))
        return F.struct(((m / n * squares - n - (m - 1)) / F.sqrt(2 * (m - 1) * (1 - 1 / n))).alias("chi"), n.alias("n"), n1.alias("n1"), runs.alias("runs"), F.try_divide(serial, spread).alias("serial"))

    def tails(z: Column) -> Column:
        n, n1 = z["n"], z["n1"]
        mu = 2 * n1 * (n - n1) / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        of_runs = F.when(var > 0, F.abs(z["runs"] - mu) / F.sqrt(F.greatest(var, F.lit(1e-9))))
        of_serial = F.abs(z["serial"] + 1 / n) * F.sqrt(n)
        two = lambda d: F.coalesce(_let(d, lambda y: F.least(F.lit(1.0), 2 * _normal_tail(y))), F.lit(1e-30))
        return -(F.log(_let(z["chi"], _normal_tail)) + F.log(two(of_runs)) + F.log(two(of_serial)))

    # Fisher: twice the sum of -log p has the chi-squared distribution with six degrees of freedom
    half = _let(_let(_let(values, sums), deviates), tails)
    return _let(half, lambda h: F.greatest(F.exp(-h) * (1 + h + h * h / 2), F.lit(1e-30)))


def _length_class(n: Column, least: int) -> Column:
    """By half doublings from `least` characters, to 16."""
    return F.least(F.lit(16), F.floor(2 * F.log2(n / F.lit(float(least))) + 1e-9)).cast("int")


def _bin(p: Column) -> Column:
    """The bin of a value; the more random, the lower."""
    return F.floor(F.least(-F.log(p), F.lit(float(MAX_NATS))) * BINS_A_NAT).cast("int")


def _scanned(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, base spans, and tokens (s, kind, e, enc, bin, klass) that overlap none of them."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(_found(text, ASSIGN, 0, 1, 12), _found(text, ACCESS, 1), _found(text, HEX, 2))
    d = d.select("doc_id", F.array_sort(base).alias("base"), _found(text, TOKEN % least, 3).alias("tokens"))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    bare = lambda t: F.rtrim(t["token"], F.lit("="))
    symbols = F.array(*(F.lit(x[2]) for x in ENCODINGS))

    def encoding(t):
        out = F.when(bare(t).rlike(ENCODINGS[0][1]), 0)
        for k, (_, pattern, _) in enumerate(ENCODINGS[1:], 1):
            out = out.when(bare(t).rlike(pattern), k)
        return out

    known = F.filter(F.transform(free, lambda t: F.struct(t["s"].alias("s"), t["kind"].alias("kind"), t["e"].alias("e"), t["token"].alias("token"), encoding(t).alias("enc"))), lambda t: t["enc"].isNotNull())
    tested = F.transform(known, lambda t: F.struct(t["s"].alias("s"), t["kind"].alias("kind"), t["e"].alias("e"), t["enc"].alias("enc"), _bin(battery(t["token"], F.element_at(symbols, t["enc"] + 1))).alias("bin"), _length_class(F.length(bare(t)).cast("double"), least).alias("klass")))
    none = F.array().cast("array<struct<s:int,kind:int,e:int,enc:int,bin:int,klass:int>>")
    return d.select("doc_id", "base", F.when(F.size("tokens") > 0, tested).otherwise(none).alias("tokens"))


def _decoys(docs: DataFrame, kinds: list[tuple[int, int]], least: int, pieces: int) -> DataFrame:
    """klass, enc, bin, n: the decoys of each (klass, enc) of kinds, from every document."""
    # without the candidates themselves
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), TOKEN % least, " ")
    by_encoding = {}
    for _, enc in kinds:
        symbols = ENCODINGS[enc][2]
        own = F.initcap(text) if any(c.islower() for c in symbols) and any(c.isupper() for c in symbols) else F.lower(text) if any(c.islower() for c in symbols) else F.upper(text)
        by_encoding[enc] = F.regexp_replace(own, f"[^{symbols.replace('-', '')}{'-' * ('-' in symbols)}]", "")
    d = docs.select(*(x.alias(f"t{enc}") for enc, x in by_encoding.items()))
    none = F.array().cast("array<struct<klass:int,enc:int,bin:int>>")

    def made(klass: int, enc: int) -> Column:
        t, long = F.col(f"t{enc}"), int(least * 2 ** (klass / 2))
        room = F.length(t) - long
        start = lambda i: F.floor(i * room / max(1, pieces - 1)).cast("int")
        piece = lambda i: F.concat(F.substring(t, start(i) + 1, F.lit(long - 1)), F.lit("2"))
        decoy = lambda i: F.struct(F.lit(klass).alias("klass"), F.lit(enc).alias("enc"), _bin(battery(piece(i), F.lit(ENCODINGS[enc][2]))).alias("bin"))
        return F.when(room >= 0, F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), decoy)).otherwise(none)

    each = [made(klass, enc) for klass, enc in kinds]
    return d.select(F.inline(F.concat(*each))).groupBy("klass", "enc", "bin").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(tokens: DataFrame, docs: DataFrame, level: float = LEVEL, least: int = LEAST, pieces: int = PIECES) -> dict[tuple[int, int], int]:
    """By length class and encoding: the last bin whose tokens (klass, enc, bin) are reported. Histograms of 17 classes, 7 encodings and 1,201 bins at most; 119 rows at most reach the driver."""
    seen = cut(tokens.groupBy("klass", "enc", "bin").agg(F.count(F.lit(1)).alias("n")))
    kinds = sorted(tuple(r) for r in seen.select("klass", "enc").distinct().collect())
    if not kinds:
        return {}
    both = seen.select("klass", "enc", "bin", "n", F.lit(0).cast("bigint").alias("decoys")).unionByName(_decoys(docs, kinds, least, pieces).select("klass", "enc", "bin", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("decoys")))
    both = both.groupBy("klass", "enc", "bin").agg(F.sum("n").alias("n"), F.sum("decoys").alias("decoys"))
    of_kind = Window.partitionBy("klass", "enc")
    up = of_kind.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("p", (1 + F.sum("decoys").over(up)) / (1 + F.sum("decoys").over(of_kind)))
    of_class = Window.partitionBy("klass")
    rank = F.sum("n").over(of_class.orderBy("p").rangeBetween(Window.unboundedPreceding, 0))
    ok = both.withColumn("ok", F.col("p") <= level * rank / F.sum("n").over(of_class))
    last = ok.withColumn("most", F.max(F.when(F.col("ok"), F.col("p"))).over(of_class)).filter("p <= most")
    return {(r[0], r[1]): r[2] for r in last.groupBy("klass", "enc").agg(F.max("bin")).collect()}


def scan(docs: DataFrame, level: float = LEVEL, least: int = LEAST, pieces: int = PIECES) -> DataFrame:
    """doc_id, base and random spans: arrays of (s, kind, e), by start, then by kind."""
    # texts are scanned once; spans are narrow
    scanned = cut(_scanned(docs, least))
    last = cutoffs(scanned.select(F.inline("tokens")), docs, level, least, pieces)
    limit = F.create_map(*[F.lit(x) for (klass, enc), bin_ in last.items() for x in (klass * len(ENCODINGS) + enc, bin_)]) if last else F.create_map().cast("map<int,int>")
    random_ = F.filter("tokens", lambda t: t["bin"] <= F.coalesce(limit[t["klass"] * len(ENCODINGS) + t["enc"]], F.lit(-1)))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))
    return scanned.select("doc_id", plain("base").alias("base"), plain(random_).alias("random"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "random"))).alias("spans"))
