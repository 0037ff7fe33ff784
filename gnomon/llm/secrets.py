"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A run of 16 or more token characters, or of characters of one alphabet of keys, whose log-likelihood ratio says
"random" becomes a span of kind `markov`, unless spans of the fixed patterns, which always stay, cover it wholly; one that
reaches beyond them stays beside them. Everything is DataFrame expressions; there is no shuffle, so no key can be hot.

Arrays that later expressions look into are bound by generators of one row, so that nothing is computed anew for each
element; running sums and maxima go block by block. So the work on a text grows with its length and number of matches.

Defined results: a null text is empty and has no spans; other columns, whatever their names, pass through `scan` and
`redact` untouched, but for those that `scan` adds, which replace columns of the same name; offsets are code points, end
exclusive; an empty table gives no rows. Runs of fewer than 16 characters are left to the fixed patterns.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R

#: Patterns in the order in which kinds are listed; the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Characters of the Markov models; position in this text is the state, and one more state stands before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Runs that the models judge: of all token characters, and, as a key may stand within a path or an assignment, those of
#: each alphabet of keys; the least ratio (nats) in all and per character.
CANDIDATES = [rf"(?<![{a}])[{a}]{{16,}}+" for a in ("A-Za-z0-9+/_=-", "A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")]
LEAST_RATIO, LEAST_RATIO_PER_CHAR = 8.0, 0.35
#: Labelled samples of each class and the pseudo-count of the models.
SAMPLES, PSEUDO = 6000, 0.5
#: Elements of a block of running sums and maxima; characters of a part from which pieces of a long text are taken.
_BLOCK, _PART = 128, 8192

#: Ordinary words from which the identifiers of the labelled sample are put together.
WORDS = (
    "get set list user name file path value index count total order item table column row data base query parse read "
    "write open close start stop time date year month day hour print format string number buffer stream token cache "
    "handler manager service client server request response error message event state config option default local "
    "global public private static return class object method function module import package version build test "
    "value update delete insert select where group having limit offset join left right inner outer text document "
    "language model train batch size learning rate score label sample random vector matrix tensor layer hidden input "
    "output weight gradient kernel window session page image color width height margin border padding content header "
    "footer title button click scroll mouse keyboard account address email phone city country street price amount "
    "currency payment invoice customer product category review comment author article chapter section paragraph "
    "the and that with from have this they which would there their what about when make like other into could "
    "der die und den von mit sich des auf für ist nicht ein eine als auch werden aus hat dass sie nach wird bei einer "
    "schaft heit keit ung lich isch gesell regier entwick verein wissen arbeit haupt stadt bund land jahr recht "
    "les des une dans est pour que qui sur pas plus par avec tout faire son mettre autre mais nous comme tion ment "
    "ance ence elle ette eur euse aire oire ique iste able ible los las una por con para como pero sus este entre "
    "cuando muy sin sobre ser tiene desde todo dos puede mente cion dad ador ando iendo ero era oso osa illo ita "
    "ing tion ness ful less ship hood ward wise able ible ment ance er est ly re un dis over under inter trans super"
).split()


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """(text, 1 for a random string or 0 for an ordinary identifier), n of each, always the same."""
    rng, out = random.Random(seed), []
    words = [w for w in WORDS if w.isascii()]
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", ALPHABET[26:52] + "234567", ALPHABET[:26] + ALPHABET[52:62])
    for i in range(n):
        a = alphabets[i % len(alphabets)]
        out.append(("".join(rng.choice(a) for _ in range(rng.randint(16, 64))), 1))
        kind, parts = i % 8, [rng.choice(words) for _ in range(rng.randint(2, 6))]
        if kind == 0:
            text = "_".join(parts)
        elif kind == 1:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif kind == 2:
            text = "-".join(parts)
        elif kind == 3:
            text = "/".join(parts)
        elif kind == 4:
            text = "_".join(parts).upper()
        elif kind == 5:
            text = "".join(str(rng.randint(0, 9)) for _ in range(rng.randint(8, 24)))
        elif kind == 6:
            text = "".join(parts) + rng.choice(("", str(rng.randint(0, 2030)), "=", "--", "/", "____"))
        else:
            text = "".join(parts).capitalize()
        out.append((text, 0))
    return out


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of (state, next character), row by row, from rows (text, label).

    Null texts and labels other than 0 and 1 don't count; characters outside the alphabet break a text. The counts
    have at most twice (1 + 67) x 67 rows, whatever the sample's size."""
    marks = samples.where(F.col("label").isin(0, 1) & F.col("text").isNotNull())
    part = F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("part")
    step = F.explode(
        F.expr("transform(filter(sequence(1, length(part)), i -> i > 0), i -> concat(if(i = 1, '^', substring(part, i - 1, 1)), substring(part, i, 1)))")
    ).alias("step")
    steps = marks.select("label", part).where("part != ''").select("label", step)
    seen = {(r["label"], r["step"]): r["count"] for r in steps.groupBy("label", "step").count().collect()}
    logs = {}
    import math

    states = "^" + ALPHABET
    for label in (0, 1):
        for a in states:
            total = sum(seen.get((label, a + b), 0) for b in ALPHABET)
            for b in ALPHABET:
                logs[label, a, b] = math.log((seen.get((label, a + b), 0) + PSEUDO) / (total + PSEUDO * len(ALPHABET)))
    return [round(logs[1, a, b] - logs[0, a, b], 6) for a in states for b in ALPHABET]


_models: dict[str, list[float]] = {}


def default_model(spark: SparkSession) -> list[float]:
    app = spark.sparkContext.applicationId
    if app not in _models:
        _models[app] = train(spark.createDataFrame(labelled_samples(), "text string, label int"))
    return _models[app]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of alphabet characters."""
    place = [0] * 128
    for i, c in enumerate(ALPHABET):
        place[ord(c)] = i + 1
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    places = F.from_json(F.lit(json.dumps(place)), "array<int>")
    n = len(ALPHABET)
    at = F.transform(F.split(token, ""), lambda c: F.element_at(places, F.ascii(c) + 1))
    end = F.aggregate(
        at,
        F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct(x.alias("p"), (a["s"] + F.element_at(table, a["p"] * n + x)).alias("s")),
    )
    return end["s"]


def _running(df: DataFrame, out: str, values: str, op: str) -> DataFrame:
    """Adds `out`: the running sum ("+") or maximum ("max") of the SQL array of longs `values`."""
    both = (lambda a, b: f"{a} + {b}") if op == "+" else (lambda a, b: f"greatest({a}, {b})")
    zero = "0L" if op == "+" else "-1L"
    v, b, p = (f"{out}_{x}" for x in "vbp")
    # Indices in place of slices: slice() goes through the whole array each time.
    fold = lambda first, last, of: f"aggregate(sequence({first}, {last}), {zero}, (a, j) -> {both('a', f'{of}[j]')})"
    df = R.bound(df, v, F.expr(f"transform({values}, x -> cast(x as bigint))"))
    blocks = fold(f"b * {_BLOCK}", f"least(size({v}), (b + 1) * {_BLOCK}) - 1", v)
    df = R.bound(df, b, F.expr(f"if(size({v}) = 0, cast(array() as array<bigint>), transform(sequence(0, int((size({v}) - 1) div {_BLOCK})), b -> {blocks}))"))
    df = R.bound(df, p, F.expr(f"transform({b}, (x, b) -> if(b = 0, {zero}, {fold('0', 'b - 1', b)}))"))
    own = fold(f"int(i div {_BLOCK}) * {_BLOCK}", "i", v)
    return R.bound(df, out, F.expr(f"transform({v}, (x, i) -> {both(f'{p}[int(i div {_BLOCK})]', own)})")).drop(v, b, p)


def _merged(df: DataFrame, out: str, spans: str, touching: bool) -> DataFrame:
    """Adds `out`: (start, end) of what the spans, which come by start, cover together; spans that touch count as one if
    `touching`."""
    df = _running(df, "top", f"transform({spans}, x -> x.end)", "max")
    apart = ">" if touching else ">="
    df = R.bound(df, "cuts", F.expr(f"filter(transform({spans}, (x, i) -> if(i = 0 or x.start {apart} top[i - 1], i, -1)), i -> i >= 0)"))
    last = "if(k + 1 < size(cuts), cuts[k + 1], size(top)) - 1"
    return R.bound(df, out, F.expr(f"transform(cuts, (i, k) -> named_struct('start', {spans}[i].start, 'end', top[{last}]))")).drop("top", "cuts")


def _step(m: str):
    return lambda z, i: F.length(z["gap"]) + F.when(i > 0, F.length(F.col(m)[i - 1])).otherwise(0)


def _passes(group: int, least: int):
    return (lambda z: F.length(F.regexp_extract(z["m"], ASSIGN, group)) >= least) if group else (lambda z: F.length(z["m"]) >= least)


def _span(rank: int, kind: str):
    return lambda z: F.struct(z["start"], z["end"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))


def _scanned(df: DataFrame, model: list[float]) -> DataFrame:
    """df (its last column: text) with base and every: arrays of (start, end, rank, kind), by start, then kind as listed."""
    names = df.columns[:-1]
    patterns = [*(regex for _, regex, _, _ in BASE), *CANDIDATES]
    steps = []
    for k, regex in enumerate(patterns):
        df = R.bound(df, f"m{k}", F.regexp_extract_all("text", F.lit(regex), F.lit(0)))
        # From the start of one match to the start of the next, by what stands between them.
        m = f"m{k}"
        gaps = F.arrays_zip(F.slice(F.split("text", regex, -1), 1, F.size(m)).alias("gap"))
        step = _step(m)
        steps.append(F.when(F.size(m) > 0, F.transform(gaps, step)).otherwise(F.array().cast("array<int>")))
    df = R.bound(df, "steps", F.concat(*steps))
    df = _running(df, "sums", "steps", "+")
    found = []
    for k in range(len(patterns)):
        before = " + ".join(["0", *(f"size(m{n})" for n in range(k))])
        base = f"if({before} = 0, 0L, sums[{before} - 1])"
        found.append(f"transform(m{k}, (m, i) -> named_struct('start', sums[{before} + i] - {base}, 'end', sums[{before} + i] - {base} + length(m), 'm', m))")
    spans = []
    for k, (kind, _, group, least) in enumerate(BASE):
        spans.append(F.transform(F.filter(F.expr(found[k]), _passes(group, least)), _span(k, kind)))
    df = R.bound(df, "base", F.array_sort(F.concat(*spans)))
    df = _merged(df, "covered", "base", True)
    # Runs that several alphabets find are judged once; of judged runs, those within another go. (array_distinct would
    # compare every struct with every other.)
    runs = F.concat(*[F.expr(f"transform({x}, z -> named_struct('start', z.start, 'back', -z.end, 'm', z.m))") for x in found[len(BASE) :]])
    df = R.bound(df, "every_run", F.array_sort(runs))
    once = F.expr("filter(transform(every_run, (x, i) -> if(i = 0 or x.start != every_run[i - 1].start or x.back != every_run[i - 1].back, x, null)), x -> x is not null)")
    judged = F.filter(once, lambda z: F.exists(F.array(ratio(z["m"], model)), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_RATIO_PER_CHAR * F.length(z["m"]))))
    df = R.bound(df, "runs", F.transform(judged, lambda z: F.struct(z["start"], (-z["back"]).alias("end"))))
    df = _running(df, "reach", "transform(runs, x -> x.end)", "max")
    df = R.bound(df, "outer", F.expr("filter(transform(runs, (x, i) -> if(i = 0 or reach[i - 1] < x.end, x, null)), x -> x is not null)"))
    both = "array_sort(concat(transform(covered, x -> named_struct('start', x.start, 'mark', 0, 'end', x.end)), transform(outer, x -> named_struct('start', x.start, 'mark', 1, 'end', x.end))))"
    df = R.bound(df, "both", F.expr(both))
    df = _running(df, "cover", "transform(both, x -> if(x.mark = 0, x.end, -1L))", "max")
    apart = "filter(transform(both, (x, i) -> if(x.mark = 1 and cover[i] < x.end, x, null)), x -> x is not null)"
    markov = F.transform(F.expr(apart), _span(len(BASE), "markov"))
    return R.bound(df, "every", F.array_sort(F.concat("base", markov))).select(*names, "text", "base", "every")


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    rows, names = R.apart(docs)
    return rows.withColumn("text", F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit("")))


def scan(spark: SparkSession, docs: DataFrame, text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """docs with base_spans and all_spans: arrays of (start, end, rank, kind), by start, then kind as listed."""
    df = _scanned(_rows(docs, text_col), model or default_model(spark))
    kept = [F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns) if c not in ("base_spans", "all_spans")]
    return df.select(*kept, F.col("base").alias("base_spans"), F.col("every").alias("all_spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda z: F.concat_ws(":", z["kind"], z["start"], z["end"])), ",")


def redact(spark: SparkSession, docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans count as one. Texts without spans, null among them,
    stay as they are."""
    df = _merged(_scanned(_rows(docs, text_col), default_model(spark)), "gone", "every", False)
    some = "size(gone) > 0"
    # A long text is cut into parts first: taking a piece out of a string counts its characters from the string's start.
    parts = f"transform(sequence(0, int(length(text) div {_PART})), p -> substring(text, p * {_PART} + 1, {_PART}))"
    df = R.bound(df, "parts", F.expr(f"if({some}, {parts}, null)"))
    kept = "transform(gone, (z, i) -> named_struct('a', if(i = 0, 0L, gone[i - 1].end), 'b', z.start))"
    df = R.bound(df, "kept", F.expr(f"if({some}, concat({kept}, array(named_struct('a', gone[size(gone) - 1].end, 'b', cast(length(text) as bigint)))), null)"))
    own = f"substring(parts[p], int(greatest(z.a - p * {_PART}, 0)) + 1, int(least(z.b - p * {_PART}, {_PART}) - greatest(z.a - p * {_PART}, 0)))"
    piece = f"if(z.a >= z.b, '', array_join(transform(sequence(int(z.a div {_PART}), int((z.b - 1) div {_PART})), p -> {own}), ''))"
    own = f"in{docs.columns.index(text_col)}"
    new = F.when(F.expr(some), F.array_join(F.expr(f"transform(kept, z -> {piece})"), mark)).otherwise(F.col(own))
    return R.restored(df.withColumn(own, new), docs)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    R.prepare(spark)
    df = scan(spark, R.load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(F.col("base_spans"), lambda z: z["kind"] == kind)).cast("long")
    return df.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"),
        F.size(F.filter("all_spans", lambda z: z["kind"] == "markov")).cast("long").alias("n_markov"),
    )
