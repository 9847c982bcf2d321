"""Column functions: times, names, phrases, sentences, scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .phrases import IRREGULAR, PHRASES, PREPOSITIONS

#: Snapshot ids count days from here; the calendar ends after LAST_DAY of them.
FIRST_DAY, LAST_DAY = "2005-01-01", 2_920_112


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space on either side (all Unicode spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    return F.lower(strip(c))


def parse_time(raw: Column) -> Column:
    """TIMESTAMP_NTZ of a time text: ASCII digits are days since FIRST_DAY, else one of four layouts; null if none fits."""
    s = strip(raw)
    days = F.when(s.rlike("^0*[0-9]{1,7}$"), F.regexp_replace(s, "^0+(?=[0-9])", "").cast("int"))
    at = F.date_add(F.lit(FIRST_DAY).cast("date"), days).cast("timestamp_ntz")
    layouts = ["yyyy-M-d", "yyyy/M/d", "yyyy-M-d'T'H:m:s", "d/M/yyyy"]
    read = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in layouts))
    return F.when(s.rlike("^[0-9]+$"), F.when(days <= LAST_DAY, at)).otherwise(read)


def date_words(raw: Column, ts: Column) -> Column:
    """``D Month YYYY``; the stripped text itself where it is no time."""
    said = F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), F.date_format(ts, "MMMM"), F.lit(" "), F.year(ts).cast("string"))
    return F.coalesce(said, strip(raw))


def pretty(name: Column) -> Column:
    return F.translate(strip(name), "_", " ")


def past(verb: Column) -> Column:
    """Simple past of one word, lower case."""
    v = F.lower(strip(verb))
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    regular = (
        F.when(v.endswith("e"), F.concat(v, F.lit("d")))
        .when(v.rlike("[^aeiou][aeiou][^aeiouwxy]$"), F.concat(v, F.right(v, F.lit(1)), F.lit("ed")))
        .when(v.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(v, "y$", ""), F.lit("ied")))
        .otherwise(F.concat(v, F.lit("ed")))
    )
    return F.coalesce(F.try_element_at(irregular, v), regular)


def phrase(relation: Column) -> Column:
    """Past-tense phrase: the known one, else the first word put in the past and a preposition added if none ends it."""
    known = F.create_map(*(F.lit(x) for pair in PHRASES.items() for x in pair))
    tidy = F.regexp_replace(strip(relation), r"(?U)\s+", " ")
    words = F.split(tidy, " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    made = F.concat_ws(" ", past(F.get(words, F.lit(0))), F.when(rest != "", rest))
    ended = F.when(made.rlike(" (" + "|".join(PREPOSITIONS) + ")$"), made).otherwise(F.concat(made, F.lit(" with")))
    return F.when(tidy == "", "interacted with").otherwise(F.coalesce(F.try_element_at(known, F.lower(strip(relation))), ended))


def phrases_of(df: DataFrame, relation: str = "relation") -> DataFrame:
    """``relation, phrase`` of the distinct relations: the phrase is worked out once for each."""
    return df.select(relation).distinct().withColumn("phrase", phrase(F.col(relation)))


def sentence(subject: Column, said: Column, obj: Column, date: Column) -> Column:
    return F.concat(F.lit("On "), date, F.lit(", "), pretty(subject), F.lit(" "), said, F.lit(" "), pretty(obj), F.lit("."))


def question(subject: Column, said: Column, date: Column) -> Column:
    who = F.when(said.endswith(" about"), F.lit(" what?")).otherwise(F.lit(" whom?"))
    return F.concat(F.lit("On "), date, F.lit(", "), pretty(subject), F.lit(" "), said, who)


def hash_score(text: Column) -> Column:
    """Deterministic pseudo-logit in [-1, 1]: the first 32 bits of the text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967295.0 * 2 - 1


def softmax(score: Column, *by: str) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def softmax_of(logits: Column) -> Column:
    """Softmax of an array; the same for all where it has no sum."""

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return F.transform(e, lambda x: F.when((total > 0) & ~F.isnan(total), x / total).otherwise(1.0 / F.size(e)))

    powers = let(logits, lambda given: let(F.array_max(given), lambda top: F.transform(given, lambda x: F.exp(x - top))))
    return let(powers, shares)


def threshold(events: Column, delta: Column, span: Column, alpha: Column) -> Column:
    """1/F + (1 - 1/F) (delta / T)^alpha; 1/F for an empty span."""
    floor = F.lit(1.0) / events
    return F.when(span <= 0, floor).otherwise(floor + (1 - floor) * F.pow(F.greatest(delta / span, F.lit(0.0)), alpha))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles (cosine, for unit vectors)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def digest(namespace: str, model: Column, payload: Column) -> Column:
    """Key of a cached response."""
    return F.sha2(F.concat_ws("\n", F.lit(namespace), model, payload), 256)


def unquote(text: Column) -> Column:
    """Without one matching pair of quotes around it."""
    return F.regexp_replace(strip(text), r"""^(?s)(["'])(.*)\1$""", "$2")


def encode_scores(labels: Column, probs: Column) -> Column:
    """Labels and their probabilities as one JSON text, as a cache keeps them."""
    return F.to_json(F.struct(labels.alias("labels"), probs.alias("probs")))


def decode_scores(text: Column) -> Column:
    """``encode_scores`` undone: a struct of labels and probs; null for any other text."""
    return F.from_json(text, "labels array<string>, probs array<double>")


def templates(spark: SparkSession) -> DataFrame:
    """The table of known phrases, for a caller who joins it."""
    return spark.createDataFrame(list(PHRASES.items()), "relation_norm string, phrase string")
