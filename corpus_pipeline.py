"""A training-corpus pipeline over documents, out of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each stage's rows as Parquet to the shared checkpoint folder and reads them
again as the next stage's input.

Documents without text or letter go in the first stage, so null texts end
there; a null in any other column stays as it is.  Extra columns of documents
are left out (``COLUMNS`` go on), whatever their names.  Rows of one id are told
apart by their text (``KEY``); of a group of copies that of the least id stays, and
of rows equal in both only one.  Empty tables give empty results.  Texts of any
length go whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, jaccard, lang_id, queries, secret_scan
from tideline.llm.staging import give_back, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: A document whose language scores less is rejected: a score of 0.25 means that no classifier has any margin.
LEAST_SCORE = 0.3


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, begun once the driver has given back what the work before it has freed."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


@lean
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised, with ``lang`` set to it.

    Rejected are ``und``, which is no text or no letter, and scores below
    LEAST_SCORE.  Without a labelled row to fit on, letters are looked for
    directly and ``lang`` stays null.
    """
    model = lang_id.fit(docs)
    give_back(spark)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = lang_id.predict(docs.select(*COLUMNS), model, keys=COLUMNS, lang="__lang", score="__score")
    kept = found.filter((F.col("__lang") != lang_id.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("__lang")).select(*COLUMNS)


KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with what tells their rows apart: the id and a hash of the text."""
    return docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).alias(KEY), *COLUMNS)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is not among the keys."""
    parts = keys.select(F.col(f"{KEY}.doc_id").alias("__id"), F.col(f"{KEY}.h").alias("__h"))
    same = F.col(f"{KEY}.doc_id").eqNullSafe(F.col("__id")) & (F.col(f"{KEY}.h") == F.col("__h"))
    return docs.join(parts, same, "left_anti")


@lean
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    keyed = _keyed(docs)
    groups = jaccard.classes(keyed.select(KEY, "text"), words=5, percent=80, key=KEY)
    kept = _without(keyed, groups.filter(~F.col(KEY).eqNullSafe(F.col("component_id"))))
    twice = keyed.groupBy(KEY).agg(F.count("*").alias("n")).filter("n > 1").select(KEY)
    if twice.limit(1).count():
        kept = _without(kept, twice).unionByName(kept.join(twice, KEY, "left_semi").dropDuplicates([KEY]))
    return kept.select(*COLUMNS)


@lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs, however long they are."""
    keyed = _keyed(docs)
    found = decontam.find(keyed.select(KEY, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=KEY)
    return _without(keyed, found.filter("n_hit > 0")).select(*COLUMNS)


@lean
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by [SECRET]; n_chars follows the text."""
    found = secret_scan.scan(docs.select(*COLUMNS), *queries.tokenizer(), keys=COLUMNS, base="__base", spans="__spans")
    text = F.col("text")
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["end"])))
    # what stands before each span, and the mark; spans that overlap make one mark
    made = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")).alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    masked = F.when(F.size("__spans") > 0, made).otherwise(text)
    out = found.select("doc_id", masked.alias("text"), "lang", "source", "n_chars", F.size("__spans").alias("__n"))
    return out.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


@lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, with the language."""
    return queries.encoded(docs, "lang")


STAGES = [
    ("language_id", keep_known_language),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, tokenizers and sets of shingles are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None
