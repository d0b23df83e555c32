"""Patterns behind a search for their literals give the counts of the patterns alone."""

import random

from pyspark.sql import functions as F

from tracelens import catalog
from tracelens.catalog import bind as B
from tracelens.functions import patterns as P
from tracelens.functions import text as T
from tracelens.operators import thinking as K

PATTERNS = [*sum(P.EXTENDED.values(), []), *P.BACKTRACKS, P.CODE_PATH, P.DEAD_END, P.PIVOT, P.ENVIRONMENT, P.FIX_MENTION, r"(?:^|\n|(?<=\.\s))(?:The|La|Is)\b", "[a-z]+ing", "x*"]
WORDS = ["not", "sure", "I", "think", "the", "issue", "\u0131\u017f\u017fue", "THE F\u0130X \u0130s", "Is", "is", "flow", "goes", "calls", "invo\u212aes", "=>", "\u2192", "x.py", "a/b", "line 3",
         "`ValueError`", "from `a` to `b`", "\u017fpecifically", "let me", "try another", "wor\u212as", "can't", "find", "won't", "work", "-", "\u2013", "stra\u00dfe", "running", "fa\u0130ling", "\n", ". "]


def test_counts_are_those_of_the_pattern_alone(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6))) for _ in range(600)] + WORDS + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for flags in ("(?iU)", "(?U)"):
        both = [F.sum(F.when(T.regexp_hits("text", p, flags) != F.regexp_count(T._text("text"), F.lit(flags + p)), 1).otherwise(0)).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
        hits = [F.sum(T.regexp_hits("text", p, flags)).alias(f"h{i}") for i, p in enumerate(PATTERNS)]
        row = df.agg(*both, *hits).first()
        assert not any(row[f"p{i}"] for i in range(len(PATTERNS)))
        assert sum(row[f"h{i}"] > 0 for i in range(len(PATTERNS))) > 10


def test_texts_without_literals_are_not_searched():
    assert T.needed_literals(r"\w+\.py") == [".py"] and T.needed_literals(r"x*") == []
    assert "contains" in str(K.rate("text", P.CODE_PATH)) and "contains" in str(T.pattern_density("text", P.EXTENDED["vague_action"]))


def test_a_text_is_folded_and_cut_into_tokens_once_for_all_densities(spark, tmp_path):
    texts = ["I need to wait", "FİX the ıſſue, hmm", " \n\t", "", None, " ", "because of the king and the ring", "waıt"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["l15_tier2_densities"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("split(") == 1
    bare = lambda p: F.regexp_count(T._text("text"), F.lit("(?iU)" + p))
    want = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", *[
        F.when(F.regexp_replace(T._text("text"), r"^\s+|\s+$", "") != "", F.round(sum(map(bare, pats)) / T.token_count("text"), 6)).alias(name) for name, pats in [*P.TIER2.items(), ("common_density", B.COMMON_PATTERNS)]])
    assert sorted(df.collect()) == sorted(want.collect())
