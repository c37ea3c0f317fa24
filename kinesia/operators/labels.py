"""Clip labels: from noisy text to checked values, and their upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesia.schema import LABEL_FIELDS

# Forms that stand for null, those of the two truth values, and the words of the other labels.
NULLISH = (
    "", "null", "none", "n/a", "na", "unknown", "uncertain", "not sure", "cannot tell", "can't tell", "cant tell", "unclear",
    "i don't know", "i dont know", "i do not know", "no se", "no sé",
)
TRUE, FALSE = ("true", "yes", "si", "1"), ("false", "no", "0")
ENUMS = {
    "indoor_outdoor": ("indoor", "outdoor"),
    "show_type": ("news anchor", "monologue", "weather report", "interview"),
    "sitting_standing": ("sitting", "standing"),
    "sex": ("male", "female"),
}
FLAGS = ("hands_free", "screen_interaction")


def json_in(text: Column) -> Column:
    """The object in a noisy answer: in a fenced block, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    bare = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), text.substr(first, last - first + 1))
    return F.when(fenced != "", fenced).otherwise(bare)


def normal(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(~v.isin(list(NULLISH)), v)


def validated(text: Column) -> Column:
    """struct(fields, error): the values of a label object, or all null and why it is refused.

    Refused: no object, other keys than the fixed ones or one of them missing, a value outside its words.  A flag is a truth value,
    the number 0 or 1, or one of its words; an age is a whole number of 0 to 120, or a text of one to three digits; the other
    labels are text.  So 1.0 and 40.0 are a flag and an age, and "1.0" and "40.0" are not.
    """
    whole = F.try_parse_json(text)
    is_object = F.startswith(F.schema_of_variant(whole), F.lit("OBJECT"))
    bag = F.when(is_object, F.from_json(text, "map<string,string>"))
    keys = F.array_sort(F.map_keys(bag))
    bad = F.lit(None).cast("string")
    values = {}
    for f in LABEL_FIELDS:
        v = F.try_variant_get(whole, f"$.{f}", "variant")
        # A number's form decides its kind here, so text never passes for one.
        kind = F.schema_of_variant(v)
        word = F.when(kind == "STRING", normal(F.try_variant_get(whole, f"$.{f}", "string")))
        number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), F.try_variant_get(whole, f"$.{f}", "double"))
        truth = F.when(kind == "BOOLEAN", F.try_variant_get(whole, f"$.{f}", "boolean"))
        none = v.isNull() | (kind == "VOID") | ((kind == "STRING") & word.isNull())
        if f in ENUMS:
            values[f] = F.when(word.isin(list(ENUMS[f])), word)
        elif f in FLAGS:
            values[f] = F.coalesce(truth, F.when(number.isin(0.0, 1.0), number == 1), F.when(word.isin(list(TRUE)), True).when(word.isin(list(FALSE)), False))
        else:
            age = F.coalesce(F.when(number == F.floor(number), number), F.when(word.rlike(r"^\d{1,3}$"), word.try_cast("double")))
            values[f] = F.when(age.between(0, 120), age).cast("int")
        bad = F.coalesce(bad, F.when(~none & values[f].isNull(), F.lit(f"{f}: value not allowed")))
    error = F.when(bag.isNull(), "no object").when(~F.coalesce(keys == F.lit(sorted(LABEL_FIELDS)), F.lit(False)), "keys differ").otherwise(bad)
    return F.struct(*[F.when(error.isNull(), values[f]).alias(f) for f in LABEL_FIELDS], error.alias("error"))


def annotation_counts(annotations: DataFrame) -> DataFrame:
    """How many rows have no error (null or blank), how many have one, and all."""
    blank = F.col("error").isNull() | (F.trim("error") == "")
    return annotations.agg(F.count_if(blank).alias("annotated"), F.count_if(~blank).alias("errors"), F.count(F.lit(1)).alias("total"))


def gate(counts: DataFrame) -> DataFrame:
    """annotation_counts with ``passes``: labels may go on if at least one clip has them."""
    return counts.withColumn("passes", F.col("annotated") > 0)


def upsert(base: DataFrame, news: DataFrame, order: str, fields: tuple[str, ...]) -> DataFrame:
    """``base`` with the fields of the newest row of news for each id; ids without news keep theirs."""
    last = news.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy(F.desc(order)))).where("_k = 1")
    last = last.select("id", F.lit(True).alias("_new"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    x = base.join(last, "id", "left")
    old = lambda f: F.col(f) if f in base.columns else F.lit(None)
    return x.select(*[c for c in base.columns if c not in fields], *[F.when(F.col("_new"), F.col(f"_n_{f}")).otherwise(old(f)).alias(f) for f in fields])


def todo(ids: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids in order that have no row with status ok yet."""
    x = ids.select("id").distinct().join(done.where("status = 'ok'"), "id", "left_anti").orderBy("id")
    return x if limit is None else x.limit(limit)


def merge_parts(scene: DataFrame, speaker: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Two partial answers for a clip: the later one's values win where they are known."""
    s = speaker.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    return scene.join(s, "id", "full").select("id", *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def frame_picks(n: Column) -> Column:
    """Five evenly spaced frames of ``n``, whole numbers downwards, each once."""
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (n - 1) / 4)))).otherwise(F.array().cast("array<bigint>"))


def spaced_picks(n: Column, k: int) -> Column:
    """``k`` evenly spaced frames, rounded half to even, each once."""
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / (k - 1), 0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
