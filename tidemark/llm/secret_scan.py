"""Secret scans with a randomness test battery, in DataFrame functions only.

Three patterns find assigned secrets, access keys and long hexadecimal runs. Beside them, every run
of at least `LEAST` characters that a key can have is a candidate; where base spans overlap it, what
they leave of it. Its encoding (hexadecimal, base 32, letters, alphanumeric, base 64) is inferred
from its characters, and four tests ask whether it is a uniform draw from that alphabet: chi-squared
uniformity, the number of runs above and below the alphabet's middle, the number of runs of one kind
of character (digits, capitals, small letters), and the serial correlation of neighbours. Its score
is four times the smallest p-value, at most 1: high for random strings.

What is reported as random must not be text in disguise, so the null hypothesis is that a candidate
is written from words. Its distribution is learned from the corpus: in every document, runs of words
at every `STRIDE`-th place are joined as programs and addresses join them (capitals, underscores,
strokes, numbers behind), and take the same tests. For each class of length and each encoding,
the candidates of the highest scores become spans of kind `random`, as many as the share of
such decoys that score as high says are false at a rate of `RATE` at most (Benjamini-Hochberg, with the decoys'
tail as p-value), and none that scores under `LEVEL`. A small corpus has few decoys, and reports less.

Places are code points, ends exclusive. A null text is empty. Rows may repeat, each counts for
itself; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, materialize
from tidemark.llm.syncmer_fingerprint import let

# The base patterns, in the order of the kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters that a candidate has at least, the rate of false random spans, and words between two decoys of a text.
LEAST, RATE, STRIDE = 20, 0.05, 48
#: Encodings by the pattern that all characters match, with the alphabet in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = [
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _DIGITS + _LOWER),
    ("^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
#: Strings that the battery itself holds for not random at this level are never reported.
LEVEL = 0.01
#: Scores are counted in bins of this many a factor of e, down to exp(-BINS / PER_E).
PER_E, BINS = 8, 240
#: Matches of a text are placed in blocks of so many, so that time grows with the text.
BLOCK = 256

_SPANS = "array<struct<kind:int,start:int,stop:int,body:string>>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_sql(text: str, pattern: str, kind: int, body_group: int = 0) -> str:
    """All leftmost matches in order, with their places: the lengths of the matches and of what lies between add up to them."""
    p = _quoted(pattern)
    length = "zip_with(slice(parts, 1, size(found)), found, (x, m) -> named_struct('gap', char_length(x), 'own', char_length(m)))"
    blocks = f"transform(sequence(0, cast((size(n) - 1) div {BLOCK} as int)), b -> slice(n, b * {BLOCK} + 1, {BLOCK}))"
    sums = "transform(blocks, k -> aggregate(k, 0, (t, x) -> t + x.gap + x.own))"
    place = "named_struct('stop', acc.stop + x.gap + x.own, 'done', array_append(acc.done, named_struct('start', acc.stop + x.gap, 'stop', acc.stop + x.gap + x.own)))"
    zero = "named_struct('stop', aggregate(slice(sums, 1, b), 0, (t, x) -> t + x), 'done', cast(array() as array<struct<start:int,stop:int>>))"
    ends = let("n", length, let("blocks", blocks, let("sums", sums, f"flatten(transform(blocks, (k, b) -> aggregate(k, {zero}, (acc, x) -> {place}, acc -> acc.done)))")))
    body = f"regexp_extract_all({text}, {p}, {body_group})"
    rows = f"zip_with({ends}, {body}, (x, y) -> named_struct('kind', {kind}, 'start', x.start, 'stop', x.stop, 'body', y))"
    whole = let("found", f"regexp_extract_all({text}, {p}, 0)", let("parts", f"split({text}, {p}, -1)", rows))
    return f"if(rlike({text}, {p}), cast({whole} as {_SPANS}), cast(array() as {_SPANS}))"


def _tail(z: str) -> str:
    """The upper tail of the normal distribution, to four decimals."""
    return f"1 / (1 + exp(least(1.5976 * ({z}) + 0.07056 * pow({z}, 3), 700D)))"


def _kind_runs() -> tuple[list[float], list[float]]:
    """For each encoding, the chance that two neighbours are of different kinds, and the variance of their number a character."""
    chance, variance = [], []
    for _, alphabet in ENCODINGS:
        kinds = [sum(c in group for c in alphabet) for group in (_DIGITS, _UPPER, _LOWER)]
        shares = [k / len(alphabet) for k in (*kinds, len(alphabet) - sum(kinds))]
        q, cubes = sum(x**2 for x in shares), sum(x**3 for x in shares)
        chance.append(1 - q)
        variance.append(q * (1 - q) + 2 * (cubes - q * q))
    return chance, variance


def encoding_sql(body: str) -> str:
    """The place of a string's encoding in ENCODINGS."""
    return "case " + " ".join(f"when {body} rlike '{p}' then {i}" for i, (p, _) in enumerate(ENCODINGS) if p) + f" else {len(ENCODINGS) - 1} end"


def battery_sql(body: str, encoding: str) -> str:
    """Four times the smallest p-value, 0 (surely not random) to 1, of a string of two characters or more."""
    of_encoding = lambda values: f"element_at(array({', '.join(values)}), e + 1)"
    chi = "(cast(char_length(a) as double) / n * aggregate(array_distinct(c), 0D, (t, x) -> t + pow(size(filter(c, y -> y = x)), 2)) - n)"
    df = "(char_length(a) - 1D)"
    z_chi = f"(pow(greatest({chi}, 0D) / {df}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df}))"
    high = "size(filter(c, x -> 2 * x >= char_length(a)))"
    runs = "(1 + size(filter(sequence(1, size(c) - 1), i -> (2 * c[i] >= char_length(a)) <> (2 * c[i - 1] >= char_length(a)))))"
    z_runs = let("h", f"cast({high} as double)", let("m", "1 + 2 * h * (n - h) / n", f"if(h = 0 or h = n, 30D, abs({runs} - m) / sqrt(greatest((m - 1) * (m - 2) / (n - 1), 1e-9D)))"))
    chance, variance = _kind_runs()
    changes = "(regexp_count(s, '[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+') - 1)"
    few = f"((n - 1) * {of_encoding([f'{x}D' for x in chance])} - {changes}) / sqrt((n - 1) * {of_encoding([f'{max(x, 1e-9)}D' for x in variance])})"
    mean = "(aggregate(c, 0D, (t, x) -> t + x) / n)"
    serial = let("mu", mean, "aggregate(sequence(1, size(c) - 1), 0D, (t, i) -> t + (c[i] - mu) * (c[i - 1] - mu)) / greatest(aggregate(c, 0D, (t, x) -> t + pow(x - mu, 2)), 1e-9D)")
    between = lambda z: let("z", z, "greatest(-30D, least(z, 30D))")
    tests = [_tail(between(z_chi)), f"2 * ({_tail(between(z_runs))})", _tail(between(few)), f"2 * ({_tail(f'least(abs({serial}) * sqrt(n), 30D)')})"]
    p = f"least(1D, {len(tests)} * least({', '.join(tests)}))"
    codes = "transform(split(s, ''), x -> locate(x, a) - 1)"
    alphabet = of_encoding([f"'{a}'" for _, a in ENCODINGS])
    return let("s", body, let("e", encoding, let("n", "cast(char_length(s) as double)", let("a", alphabet, let("c", codes, p)))))


def scored_sql(body: str) -> str:
    """A struct of length class (20 to 31, 32 to 63, 64 and more as 4 to 6), encoding, and bin of the score."""
    score = f"cast(least(floor(-ln(greatest({battery_sql('y', 'k')}, 1e-300D)) * {PER_E}), {BINS}) as int)"
    length = "cast(least(floor(log2(char_length(y))), 6) as int)"
    return let("y", body, let("k", encoding_sql("y"), f"named_struct('class', {length}, 'encoding', k, 'bin', {score})"))


def decoys_sql(text: str, stride: int = STRIDE) -> str:
    """Strings written from the words of a text, as identifiers, paths and slugs are."""
    lower, capital = "transform(v, x -> lower(x))", "transform(v, x -> initcap(x))"
    styles = [f"array_join({capital}, '')", f"concat(array_join({capital}, ''), g)", f"concat(array_join({lower}, ''), g)", f"array_join({lower}, '')", f"concat(array_join({lower}, '-'), '-', g)", f"array_join({lower}, '/')", f"concat(upper(array_join(v, '_')), g)"]
    number = "cast(pmod(h div 256, element_at(array(10, 100, 10000, 1000000), cast(pmod(h div 32, 4) as int) + 1)) as string)"
    joined = f"element_at(array({', '.join(styles)}), cast(pmod(h, {len(styles)}) as int) + 1)"
    one = let("h", "pmod(xxhash64(w[i - 1], i), 1099511627776L)", let("v", "slice(w, i, element_at(array(3, 5, 8, 14), cast(pmod(h div 8, 4) as int) + 1))", let("g", number, joined)))
    return let("w", f"regexp_extract_all({text}, '[A-Za-z]{{2,}}', 0)", f"if(size(w) = 0, cast(array() as array<string>), filter(transform(sequence(1, size(w), {stride}), i -> {one}), x -> char_length(x) >= {LEAST}))")


def score_bounds(scored: DataFrame, rate: float = RATE) -> dict[tuple[int, int], int]:
    """For each (class of length, encoding), the last bin that is reported. At most 3 x 11 counts of BINS + 1 bins meet in
    a window; a row for each of the 33 comes to the driver."""
    counted = [scored.select(F.lit(i).alias("decoy"), F.explode(c).alias("x")).groupBy("x.class", "x.encoding", "x.bin").agg(F.sum(1 - F.col("decoy")).alias("real"), F.sum("decoy").alias("false")) for i, c in enumerate(("scores", "decoys"))]
    bins = counted[0].unionByName(counted[1]).groupBy("class", "encoding", "bin").agg(F.sum("real").alias("real"), F.sum("false").alias("false"))
    upto = Window.partitionBy("class", "encoding").orderBy("bin")
    totals = bins.groupBy("class").agg(F.sum("real").alias("all_real"), F.sum("false").alias("all_false"))
    ranked = bins.withColumn("reported", F.sum("real").over(upto)).withColumn("alike", F.sum("false").over(upto)).join(F.broadcast(totals), "class")
    passing = ranked.where(F.col("bin") <= math.floor(-math.log(LEVEL) * PER_E)).where((F.col("alike") + 1) / (F.col("all_false") + 1) * F.col("all_real") <= rate * F.col("reported"))
    return {(r["class"], r["encoding"]): r["last"] for r in passing.groupBy("class", "encoding").agg(F.max("bin").alias("last")).collect()}


def _in_order(spans: str) -> str:
    return f"array_sort({spans}, (x, y) -> case when x.start < y.start then -1 when x.start > y.start then 1 else x.kind - y.kind end)"


def scan_secrets(docs: DataFrame, rate: float = RATE, stride: int = STRIDE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base and spans: arrays of (kind, start, stop, body), kind as a place in KINDS."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = f"filter({spans_sql('text', ASSIGN, 0, 2)}, x -> char_length(x.body) >= 6)"
    base = _in_order(f"concat({assign}, {spans_sql('text', ACCESS, 1)}, {spans_sql('text', HEX, 2)})")
    found = rows.select("doc_id", F.expr(base).alias("base"), F.expr(spans_sql("text", CANDIDATE, 3)).alias("runs"), F.expr(decoys_sql("text", stride)).alias("written"))
    # what base spans leave of a run
    piece = "named_struct('kind', 3, 'start', acc.at, 'stop', y.start, 'body', substring(x.body, acc.at - x.start + 1, y.start - acc.at))"
    step = f"named_struct('at', greatest(acc.at, y.stop), 'out', if(y.start > acc.at, array_append(acc.out, {piece}), acc.out))"
    touching = "filter(base, y -> y.start < x.stop and x.start < y.stop)"
    left = f"aggregate(concat({touching}, array(named_struct('kind', 3, 'start', x.stop, 'stop', x.stop, 'body', ''))), named_struct('at', x.start, 'out', cast(array() as {_SPANS})), (acc, y) -> {step}, acc -> acc.out)"
    pieces = f"filter(flatten(transform(runs, x -> if(exists(base, y -> y.start < x.stop and x.start < y.stop), {left}, array(x)))), x -> char_length(x.body) >= {LEAST})"
    cut = found.select("doc_id", "base", F.expr(pieces).alias("candidates"), "written")
    scored = cut.select("doc_id", "base", "candidates", F.expr(f"transform(candidates, q -> {scored_sql('q.body')})").alias("scores"), F.expr(f"transform(written, q -> {scored_sql('q')})").alias("decoys"))
    scored = materialize(scored)
    bounds = score_bounds(scored, rate)
    bound = "case " + " ".join(f"when y.class = {c} and y.encoding = {e} then {b}" for (c, e), b in sorted(bounds.items())) + " else -1 end" if bounds else "-1"
    random = f"filter(zip_with(candidates, scores, (x, y) -> if(y.bin <= {bound}, x, null)), x -> x is not null)"
    return scored.select("doc_id", "base", F.expr(_in_order(f"concat(base, {random})")).alias("spans"))


def _spelled(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1), ':', x.start, ':', x.stop)), ',')"


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(F.expr(f"cast({_spelled('base')} as binary)"), 256).alias("base_sha256"), F.expr(_spelled("spans")).alias("spans"))
