"""Personal data: formats, and bootstrapped contextual extraction (operator 3); DataFrame functions only.

The four base kinds are found by their formats. An instance is a white-space run
of a text with a digit or an at sign in it, or an underscore between other signs
(a card or telephone number with its spaces is one instance), without the signs
around it; its lexical pattern is the two words before it, in lower case, as far
as they lie within CONTEXT code points. Seed entities are the instances that hold
a valid base match, and those of the form in SECRETS (kind ``secret``).

Patterns and distinct instances form a graph, which is scored in ROUNDS rounds. A
pattern is supported for a kind if MIN_SEEDS or more of its instances have a
confidence of MIN_CONFIDENCE for it; its precision is the sum of its instances'
confidences over their number (smoothed). A seed's confidence is 1, that of any
other instance the noisy-or of the precisions of the supported patterns that
introduce it; instances that become confident count as seeds in the next round, so
they can bring in new patterns. In the end supported patterns with a precision of
MIN_PRECISION are trusted. Instances that a trusted pattern introduces, and further
occurrences of instances that trusted patterns make confident, are new spans of
kind ``ctx-`` + kind unless a base span overlaps them; a form in SECRETS alone is
never reported.

Offsets are code points, ends exclusive. Null texts count as empty. Repeated rows
are reported each, and their instances count once, as a pattern's instances are
distinct. Of an instance with several kinds the least counts. Null ids stay. Only
the id and text columns are read. Work is linear in a text's length, but for the
running sums, which grow with a 64th of the square of a text's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept, materialise, restored

ROUNDS, MIN_SEEDS, MIN_PRECISION, MIN_CONFIDENCE, SMOOTH, CONTEXT = 3, 5, 0.8, 0.9, 0.5, 96
KINDS = ("email", "ip", "card", "phone")
#: The contract's formats. Lookbehinds only spare starts that can't lead to another match, and
#: possessive loops only give up ways back that can't succeed: long runs stay linear.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that only count as seeds: keys of 160 bits as lower-case hexadecimal digits.
SECRETS = "^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{40}$"
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPAN = "array<struct<kind:string,start:int,end:int,low:int,high:int>>"
_SIGNS = r"[^\s\p{L}\p{N}+@]"
#: Telephone or card numbers with their spaces, else any run that looks like an identifier.
_INSTANCE = rf"(?<!\S)(?:{_SIGNS}*+(?:\+[0-9][\x20().0-9-]*[0-9]|[0-9](?:[\x20-]?+[0-9])++)(?![\p{{L}}\p{{N}}@_.-]*[\p{{L}}@_])\S*+|(?=[^\s0-9@]*+[0-9@]|\S*?[^\s_]_++[^\s_])\S++)"
_LOOKS = "[0-9@]|[^\\s_]_+[^\\s_]"
#: Elements that a running sum folds at once.
_STRETCH = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """16 to 19 digits whose weighted sum ends in 0; zeros put before them change nothing."""

    def holds(d: Column) -> Column:
        total = F.lit(0)
        padded = F.lpad(d, 20, "0")
        for i in range(20):
            v = F.substring(padded, i + 1, 1).cast("int")
            total = total + (v if i % 2 else v * 2 - F.when(v > 4, 9).otherwise(0))
        return F.length(d).between(16, 19) & (total % 10 == 0)

    return _let(_digits(match), holds)


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _before(values: Column, merge) -> Column:
    """For each integer of an array the sum (or greatest …) of those before it, 0 for none.

    Stretches are folded by themselves and then among each other: a fold over the
    whole array would copy what it has for every element.
    """
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, value: Column) -> Column:
        return F.struct(merge(state["at"], value).cast("int").alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

    def stretches(v: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(v), F.lit(_STRETCH))
        folded = F.transform(cuts, lambda i: F.aggregate(F.slice(v, i, F.lit(_STRETCH)), nothing, step))
        return _let(folded, lambda f: F.flatten(F.zip_with(f, F.aggregate(F.transform(f, lambda x: x["at"]), nothing, step)["out"], lambda x, base: F.transform(x["out"], lambda y: merge(base, y).cast("int")))))

    return _let(values, lambda v: F.when(F.size(v) > 0, stretches(v)).otherwise(F.array().cast("array<int>")))


def _located(text: Column, pattern: str, make) -> Column:
    """Array of ``make(match, start, first byte, text before)`` over all matches.

    Matches and the pieces between them alternate, so starts are running sums of
    lengths. The text before reaches back over the last two matches.
    """
    pieces = F.split(text, pattern)

    def place(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(m.alias("match"), p.alias("piece")))

        def each(ps: Column, chars: Column, octets: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                last, last_but_one = F.get(ps, i - 1), F.get(ps, i - 2)
                before = F.concat(F.coalesce(last_but_one["match"], F.lit("")), F.coalesce(last["piece"], F.lit("")), F.coalesce(last["match"], F.lit("")), p["piece"])
                return make(p["match"], F.get(chars, i) + F.length(p["piece"]), F.get(octets, i) + F.octet_length(p["piece"]), before)

            return F.transform(ps, one)

        total = lambda a, b: a + b
        chars = lambda ps: _before(F.transform(ps, lambda p: F.length(p["piece"]) + F.length(p["match"])), total)
        octets = lambda ps: _before(F.transform(ps, lambda p: F.octet_length(p["piece"]) + F.octet_length(p["match"])), total)
        return _let(pairs, lambda ps: _let(chars(ps), lambda c: _let(octets(ps), lambda o: each(ps, c, o))))

    none = F.filter(F.array(make(F.lit(""), F.lit(0), F.lit(0), F.lit(""))), lambda _: F.lit(False))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _span(kind: Column, start: Column, low: Column, text: Column) -> list[Column]:
    ends = (F.length(text), F.octet_length(text))
    return [kind.alias("kind"), start.cast("int").alias("start"), (start + ends[0]).cast("int").alias("end"), low.cast("int").alias("low"), (low + ends[1]).cast("int").alias("high")]


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one base kind as an array of (kind, start, end, first byte, end in bytes)."""

    def make(match: Column, start: Column, low: Column, _: Column) -> Column:
        return F.struct(*_span(F.when(_VALID[kind](match), F.lit(kind)), start, low, match))

    found = F.filter(_located(text, FORMATS[kind], make), lambda s: s["kind"].isNotNull())
    needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(needed, found).otherwise(F.array().cast(_SPAN))


def _seed_kind(text: Column) -> Column:
    """The kind of a seed entity, by its own text; null for any other instance."""

    def holds(kind: str) -> Column:
        needed = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        return needed & F.exists(F.regexp_extract_all(text, F.lit(FORMATS[kind]), F.lit(0)), _VALID[kind])

    kind = F.when(text.rlike(SECRETS), F.lit("secret"))
    for k in sorted(KINDS, reverse=True):
        kind = F.when(holds(k), F.lit(k)).otherwise(kind)
    return kind


def _instances(text: Column) -> Column:
    """(kind, start, end, low, high, text, pattern) of identifier-like runs; kind is null for all but seeds."""

    def make(match: Column, start: Column, low: Column, before: Column) -> Column:
        # signs that hang on either side belong to the sentence
        tail = F.regexp_replace(match, rf"^{_SIGNS}++", "")
        core = F.regexp_replace(tail, r"[^\p{L}\p{N}]++$", "")
        span = _span(F.lit(None).cast("string"), start + F.length(match) - F.length(tail), low + F.octet_length(match) - F.octet_length(tail), core)
        return F.struct(*span[1:], core.alias("text"), F.lower(F.right(before, F.lit(CONTEXT))).alias("before"))

    def label(x: Column) -> Column:
        words = F.filter(F.split(x["before"], r"\s+"), lambda w: w != "")
        # a word that touches the instance isn't there: runs are between white space
        pattern = _let(words, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)), " "))
        return F.struct(_seed_kind(x["text"]).alias("kind"), *(x[c].alias(c) for c in ("start", "end", "low", "high", "text")), pattern.alias("pattern"))

    every = F.transform(F.filter(_located(text, _INSTANCE, make), lambda x: F.length(x["text"]) >= 4), label)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,low:int,high:int,text:string,pattern:string>>")
    return F.when(text.rlike(_LOOKS), every).otherwise(none)


def found_spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``uid, doc_id, base (spans), instances``, with the columns of ``keep`` as kept_0 …; materialised."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), *kept(keep))
    kinds = [base_spans(F.col("body"), k) for k in KINDS]
    rows = rows.withColumn("base", F.when(F.col("body").rlike("[0-9@]"), F.concat(*kinds)).otherwise(F.array().cast(_SPAN)))
    rows = rows.withColumn("instances", _instances(F.col("body")))
    return materialise(rows.drop("body"), "spans")


def patterns(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trusted ``(pattern, kind)`` and confident ``(text, kind)``, by rounds over the pattern-instance graph."""
    seen = found.select(F.explode("instances").alias("x")).select("x.text", "x.pattern", "x.kind").filter("pattern <> ''")
    graph = materialise(seen.groupBy("pattern", "text").agg(F.min("kind").alias("kind")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count("*").alias("size"))
    seeds = graph.filter("kind is not null").groupBy("text").agg(F.min("kind").alias("kind")).withColumn("confidence", F.lit(1.0))
    edges = graph.select("pattern", "text")
    confidence = materialise(seeds, "seeds")
    for _ in range(rounds):
        support = edges.join(confidence, "text").groupBy("pattern", "kind").agg(F.sum("confidence").alias("sum"), F.count_if(F.col("confidence") >= MIN_CONFIDENCE).alias("sure"))
        scored = support.filter(F.col("sure") >= MIN_SEEDS).join(sizes, "pattern")
        scores = materialise(scored.select("pattern", "kind", (F.col("sum") / (F.col("size") + SMOOTH)).alias("precision")), "scores")
        doubt = edges.join(scores, "pattern").groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("confidence"))
        others = doubt.join(seeds.select("text"), "text", "left_anti")
        confidence = materialise(seeds.unionByName(others), "confidence")
    best = scores.filter(F.col("precision") >= MIN_PRECISION).groupBy("pattern").agg(F.max_by("kind", F.struct("precision", "kind")).alias("kind"))
    trusted = materialise(best, "trusted")
    # what trusted patterns alone make confident
    sure = edges.join(scores.join(trusted, ["pattern", "kind"], "left_semi"), "pattern").groupBy("text", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("confidence"))
    sure = sure.filter(F.col("confidence") >= MIN_CONFIDENCE).groupBy("text").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return trusted, sure


def added_spans(found: DataFrame) -> DataFrame:
    """``uid, added (spans)`` of rows in which trusted patterns or confident instances find more."""
    trusted, sure = patterns(found)
    place = ["uid", "start", "end", "low", "high"]
    open_ones = found.select("uid", F.explode("instances").alias("x")).filter("x.kind is null or x.kind = 'secret'").select("uid", "x.start", "x.end", "x.low", "x.high", "x.text", "x.pattern")
    by_pattern = open_ones.join(trusted, "pattern").select(*place, "kind")
    by_text = open_ones.join(sure, "text").select(*place, "kind")
    both = materialise(by_pattern.unionByName(by_text).groupBy(*place).agg(F.min("kind").alias("kind")), "added")
    # those that no base span overlaps: base spans are apart, so the last one begun and the next one tell
    bases = found.join(both.select("uid").distinct(), "uid", "left_semi").select("uid", F.explode("base").alias("x")).select("uid", "x.start", "x.end", "x.low", "x.high", F.lit(None).cast("string").alias("kind"))
    begun = Window.partitionBy("uid").orderBy("start", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("uid").orderBy("start", F.col("kind").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = F.col("kind").isNull()
    rows = both.unionByName(bases).withColumn("until", F.max(F.when(base, F.col("end"))).over(begun)).withColumn("next", F.min(F.when(base, F.col("start"))).over(ahead))
    rows = rows.filter(~base & (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    span = F.struct(F.concat(F.lit("ctx-"), F.col("kind")).alias("kind"), "start", "end", "low", "high")
    return rows.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``uid, doc_id, base, added`` (arrays of kind, start, end, and both in bytes) and the columns of ``keep`` as kept_0 …."""
    found = found_spans(docs, keep)
    return found.join(added_spans(found), "uid", "left").withColumn("added", F.coalesce("added", F.array().cast(_SPAN))).drop("instances")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets, and ``n_chars`` put right if present.

    Where spans overlap, the first (then longest) is replaced and the rest of the
    others with it. Texts are cut by bytes, so that no cut has to count code points.
    """
    columns = docs.columns
    rows = personal_data(docs, tuple(columns))
    text = F.col(f"kept_{columns.index('text')}").cast("string")

    def clean(spans: Column, reach: Column, raw: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.get(reach, i)
            cut = F.substring(raw, at + 1, s["low"] - at).cast("string")
            return F.when(s["low"] >= at, F.concat(cut, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))

        last = F.greatest(F.get(reach, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["high"])
        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

    by_start = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["low"].alias("low"), (-s["high"]).alias("last"), s["high"].alias("high"), s["kind"].alias("kind"))))
    greatest = lambda a, b: F.greatest(a, b)
    done = _let(by_start, lambda ss: _let(_before(F.transform(ss, lambda s: s["high"]), greatest), lambda reach: _let(F.encode(text, "UTF-8"), lambda raw: clean(ss, reach, raw))))
    out = rows.withColumn(f"kept_{columns.index('text')}", F.when(F.size("base") + F.size("added") > 0, done).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn(f"kept_{columns.index('n_chars')}", F.length(f"kept_{columns.index('text')}").cast(docs.schema["n_chars"].dataType))
    return out.select(*restored(columns))


def op3_pii(docs: DataFrame) -> DataFrame:
    rows = personal_data(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added, every = F.size("added"), F.size("base") + F.size("added")
    return rows.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), added.cast("long").alias("n_added"), every.cast("long").alias("n_spans"))
