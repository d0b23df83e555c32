"""Text and predicate queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import shell
from ..functions import text as T
from . import bind as B
from .registry import query

A = B.ascii_of("text")
AL = f"lower({A})"


def per_text(name: str, cols: dict, dbl: str = "", lng: str = "", shared: dict | None = None) -> None:
    """Register a query of scalar columns over every document; cols: name → (function giving the column, sql).

    Columns that several of them read are worked out once a text; shared: name → function giving the column.
    """
    body = ", ".join(f"{sql} AS {c}" for c, (_, sql) in cols.items())

    @query(name, f"SELECT doc_id, {body} FROM documents", dbl=dbl, lng=lng)
    def run(t):
        docs = t.documents
        if shared:
            docs = docs.select("doc_id", "text", *[col().alias(c) for c, col in shared.items()])
        return docs.select("doc_id", *[col().alias(c) for c, (col, _) in cols.items()])


per_text("l1_tokenise", {
    "tokens": (lambda: F.array_join(T.tokens("text"), " "), f"array_to_string({B.toks('lower(text)')}, ' ')"),
    "tokens_case": (lambda: F.array_join(T.tokens("text", lower=False), " "), f"array_to_string({B.toks('text')}, ' ')"),
})
per_text("l2_token_count", {"tokens": (lambda: T.token_count("text"), B.ntok("text"))}, lng="tokens")
per_text("l4_token_estimate", {
    "estimate": (lambda: T.token_estimate("text"), "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END")}, lng="estimate")
per_text("l5_lexicon_density", {
    "common": (lambda: T.lexicon_density("text", B.COMMON_WORDS),
               B.per_tok(f"len(list_filter({B.toks('lower(text)')}, lambda x: x IN {B.in_list(B.COMMON_WORDS)}))", "text")),
    "hedges": (lambda: T.lexicon_density("text", P.HEDGE_WORDS),
               B.per_tok(f"len(list_filter({B.toks('lower(text)')}, lambda x: x IN {B.in_list(P.HEDGE_WORDS)}))", "text")),
}, dbl="common hedges")
per_text("l6_pattern_count", {
    "common": (lambda: T.pattern_hits("text", B.COMMON_PATTERNS), B.hits_all(A, B.COMMON_PATTERNS)),
    "alternatives": (lambda: T.pattern_hits("text", P.ALTERNATIVES), B.hits_all(A, P.ALTERNATIVES)),
}, lng="common alternatives")
per_text("l7_pattern_density", {
    "density": (lambda: T.pattern_density("text", B.COMMON_PATTERNS), B.per_tok(B.hits_all(A, B.COMMON_PATTERNS), "text"))}, dbl="density")
per_text("l8_substring_density", {
    "density": (lambda: T.substring_density("text", B.COMMON_PARTS), B.per_tok(B.sub_hits("text", B.COMMON_PARTS), "text"))}, dbl="density")
_alt = r"\b(?:the|of the|and|that|it is)\b"
per_text("l9_alternation_density", {
    "density": (lambda: T.alternation_density("text", _alt),
                f"CASE WHEN length(text) >= 10 THEN {B.hits(AL, _alt, '')} / greatest({B.ntok('text')}, 1) ELSE 0.0 END")}, dbl="density")
per_text("l10_per_kilochar", {
    "density": (lambda: T.per_kilochar("text", B.COMMON_PATTERNS),
                f"coalesce(CAST({B.hits_all(A, B.COMMON_PATTERNS)} AS DOUBLE) / nullif(length(text), 0) * 1000, 0.0)")}, dbl="density")


def _edge_score(words, phrases):
    bare = f"list_transform({B.toks('lower(text)')}, lambda x: trim(x, '.,;:!?()'))"
    hit = f"len(list_filter({bare}, lambda x: x IN {B.in_list(words)}))"
    return B.per_tok(f"({hit} + {B.sub_hits('text', phrases)})", "text")


_w, _ph = ["the", "with", "that"], ["of the", "in the"]
per_text("l12_verification_score", {
    "score": (lambda: T.verification_score("text"), _edge_score(P.VERIFICATION_WORDS, P.VERIFICATION_PHRASES)),
    "common": (lambda: T.word_phrase_score("text", _w, _ph), _edge_score(_w, _ph)),
}, dbl="score common")
_w2, _ph2 = ["for", "la", "und", "es"], ["to the", "de la"]
per_text("l13_planning_score", {
    "score": (lambda: T.planning_score("text"), _edge_score(P.PLANNING_WORDS, P.PLANNING_PHRASES)),
    "common": (lambda: T.word_phrase_score("text", _w2, _ph2), _edge_score(_w2, _ph2)),
}, dbl="score common")
_revise = [r"\bnot\b", r"\bis,", r"\bit was\b", r"\bthe\b"]
per_text("l14_alternatives_backtracks", {
    "alternatives": (lambda: T.alternatives_considered("text"), B.hits_all(A, P.ALTERNATIVES)),
    "backtracks": (lambda: T.backtrack_count("text"), B.hits_all(A, P.BACKTRACKS)),
    "common": (lambda: T.pattern_hits("text", _revise), B.hits_all(A, _revise)),
}, lng="alternatives backtracks common")
_sets = {**P.TIER2, "common_density": B.COMMON_PATTERNS}
per_text("l15_tier2_densities", {
    name: (lambda pats=pats: F.when(T.has_text("text"), T.pattern_density("text", pats, low="low", n="n")),
           f"CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN {B.per_tok(B.hits_all(A, pats), 'text')} END")
    for name, pats in _sets.items()
}, dbl=" ".join(_sets), shared={"low": lambda: T.folded("text"), "n": lambda: T.token_count("text")})
per_text("l16_tentative_insight_hedging", {
    **{name: (lambda name=name: T.alternation_density("text", P.ALTERNATIONS[name]),
              f"CASE WHEN length(text) >= 10 THEN {B.hits(AL, P.ALTERNATIONS[name], '')} / greatest({B.ntok('text')}, 1) ELSE 0.0 END")
       for name in ("tentative_density", "insight_density", "hedging_density")},
    "tentative_parts": (lambda: T.substring_density("text", P.SUBSTRINGS["tentative_density"]),
                        B.per_tok(B.sub_hits("text", P.SUBSTRINGS["tentative_density"]), "text")),
    "common_parts": (lambda: T.substring_density("text", ["th", "en "]), B.per_tok(B.sub_hits("text", ["th", "en "]), "text")),
}, dbl="tentative_density insight_density hedging_density tentative_parts common_parts")
per_text("l17_precision_naming", {
    "strict": (lambda: T.precision_naming("text"), B.per_tok(B.hits_all(A, P.NAMING, ""), "text")),
    "loose": (lambda: T.precision_naming("text", loose=True), B.per_tok(B.hits_all(A, P.NAMING_LOOSE, ""), "text")),
}, dbl="strict loose")
per_text("l26_truncate", {
    "short": (lambda: T.truncate("text", 200), "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END")})


@query("l3_deliberation_chars",
       "SELECT source, coalesce(avg(CASE WHEN regexp_replace(text, '\\s', '', 'g') <> '' THEN length(text) END), 0) AS mean_chars FROM documents GROUP BY source",
       dbl="mean_chars")
def _l3(t):
    return t.documents.groupBy("source").agg(
        F.coalesce(F.avg(F.when(T.has_text("text"), F.length("text"))), F.lit(0.0)).alias("mean_chars"))


@query("l11_hit_rate", f"""SELECT source, avg(CASE WHEN regexp_matches({A}, '(?i)the|und') THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate,
    avg(CASE WHEN regexp_matches({A}, '(?i){P.BACKTRACK_OPEN}') THEN 1.0::DOUBLE ELSE 0 END) AS backtrack_rate FROM documents GROUP BY source""",
       dbl="hit_rate backtrack_rate")
def _l11(t):
    rate = lambda p: F.avg(F.col("text").rlike("(?i)" + p).cast("double"))
    return t.documents.groupBy("source").agg(rate("the|und").alias("hit_rate"), rate(P.BACKTRACK_OPEN).alias("backtrack_rate"))


@query("l5_lexicon_join", f"""WITH words AS (SELECT doc_id, unnest({B.toks('lower(text)')}) AS term FROM documents),
    lexicon AS (SELECT DISTINCT w AS term FROM (SELECT unnest({B.toks('lower(text)')}) AS w FROM benchmark)),
    marked AS (SELECT doc_id, count(*) AS c, count(*) FILTER (term IN (SELECT term FROM lexicon)) AS h FROM words GROUP BY doc_id)
    SELECT d.doc_id, coalesce(h / c, 0.0) AS density FROM documents d LEFT JOIN marked m USING (doc_id)""", dbl="density")
def _l5_join(t):
    """The vocabulary of the benchmark table as a lexicon too large for an expression."""
    lexicon = t.read("benchmark").select(F.explode(T.tokens("text")).alias("term")).distinct()
    return T.lexicon_density_by_join(t.documents, "doc_id", "text", lexicon)


@query("l10_run_level_ratio",
       f"SELECT source, coalesce(sum({B.hits('text', 'but|the|und')})::DOUBLE / nullif(sum(length(text)), 0) * 1000, 0) AS per_kchar FROM documents GROUP BY source",
       dbl="per_kchar")
def _l10b(t):
    count = F.sum(F.regexp_count("text", F.lit("(?i)but|the|und")))
    return t.documents.groupBy("source").agg(
        F.coalesce(F.try_divide(count.cast("double"), F.sum(F.length("text")).cast("double")) * 1000, F.lit(0.0)).alias("per_kchar"))


@query("l18_alignment", f"""SELECT run_id, seq,
    CASE WHEN tool_name IN ('Edit', 'Write') AND reasoning_text IS NOT NULL THEN CASE WHEN contains(reasoning_text, 'er') THEN 1.0::DOUBLE ELSE 0.0 END END AS by_name,
    CASE WHEN tool_name IN ('Edit', 'Write') THEN CASE WHEN contains(coalesce(reasoning_text, ''), 'er') THEN 1.0::DOUBLE ELSE 0.0 END END AS by_zero,
    CASE WHEN tool_name IN ('Edit', 'Write') AND reasoning_text IS NOT NULL THEN CASE WHEN contains(lower(reasoning_text), 'the') THEN 1.0::DOUBLE ELSE 0.0 END END AS by_stem
    FROM attributed""", dbl="by_name by_zero by_stem")
def _l18(t):
    from .attributed import attributed
    calls = attributed(t)
    path, stem = F.lit("src/er"), F.lit("src/the.py")
    return calls.select(
        "run_id", "seq", T.alignment("reasoning_text", "tool_name", path).alias("by_name"),
        T.alignment("reasoning_text", "tool_name", path, "zero").alias("by_zero"),
        T.alignment("reasoning_text", "tool_name", stem, "stem").alias("by_stem"))


# Test output, targets, verdicts and paths are written into texts that carry numbers of the events.
_OUT = "CASE k % 6 WHEN 0 THEN k || ' passed, ' || (k % 4) || ' failed in 1s' WHEN 1 THEN 'Ran ' || k || ' tests' || chr(10) || 'OK' WHEN 2 THEN 'Ran ' || k || ' tests FAILED (failures=' || (k % 5) || ', errors=1)' WHEN 3 THEN 'Ran ' || k || ' tests FAILED' WHEN 4 THEN 'tests finished: ' || k || ' passed' ELSE 'nothing to do' END"


def _output(k):
    s = k.cast("string")
    m = lambda n: F.pmod(k, F.lit(n))
    return (
        F.when(m(6) == 0, F.concat(s, F.lit(" passed, "), m(4).cast("string"), F.lit(" failed in 1s")))
        .when(m(6) == 1, F.concat(F.lit("Ran "), s, F.lit(" tests\nOK")))
        .when(m(6) == 2, F.concat(F.lit("Ran "), s, F.lit(" tests FAILED (failures="), m(5).cast("string"), F.lit(", errors=1)")))
        .when(m(6) == 3, F.concat(F.lit("Ran "), s, F.lit(" tests FAILED")))
        .when(m(6) == 4, F.concat(F.lit("tests finished: "), s, F.lit(" passed")))
        .otherwise("nothing to do")
    )


@query("l22_test_output_counts", """SELECT event_id,
    CASE k % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN greatest(0, k - (k % 5) - 1) WHEN 3 THEN greatest(0, k - 1) WHEN 4 THEN k ELSE 0 END AS passed,
    CASE k % 6 WHEN 0 THEN k % 4 WHEN 2 THEN k % 5 + 1 WHEN 3 THEN 1 ELSE 0 END AS failed FROM calls""", lng="passed failed")
def _l22(t):
    passed, failed = T.test_counts("out")
    return t.raw_calls.select("event_id", _output(F.col("k")).alias("out")).select(
        "event_id", passed.alias("passed"), failed.alias("failed"))


@query("l23_test_targets", """SELECT event_id, CASE k % 3 WHEN 0 THEN 'T' || k || '|test_' || k || '|test_m.py' WHEN 1 THEN 'm' || k || '.py' ELSE 'test_k' || k END AS targets FROM calls""")
def _l23(t):
    k = F.col("k").cast("string")
    cmd = (
        F.when(F.pmod("k", F.lit(3)) == 0, F.concat(F.lit("pytest a/test_m.py::T"), k, F.lit("::test_"), k))
        .when(F.pmod("k", F.lit(3)) == 1, F.concat(F.lit("python src/m"), k, F.lit(".py -v")))
        .otherwise(F.concat(F.lit("tox test_k"), k)))
    return t.raw_calls.select("event_id", F.array_join(T.test_targets(cmd), "|").alias("targets"))


@query("l24_verdict_text", """SELECT doc_id, CASE WHEN regexp_replace(text, '\\s', '', 'g') = '' THEN 'approve'
    WHEN doc_id % 5 = 0 THEN 'approve' WHEN doc_id % 5 = 1 THEN 'concern' WHEN doc_id % 5 = 2 THEN 'reject'
    WHEN contains(lower(text), 'reject') THEN 'reject' WHEN contains(lower(text), 'concern') THEN 'concern'
    WHEN doc_id % 5 = 3 AND contains(lower(text), 'tion') THEN 'reject' ELSE 'approve' END AS verdict FROM documents""")
def _l24(t):
    """Answers made of a verdict prefix, or a keyword in the text, and the document."""
    m = F.pmod("doc_id", F.lit(5))
    head = F.when(m == 0, "Approve - ").when(m == 1, "CONCERN: ").when(m == 2, "reject: ").otherwise("")
    tail = F.when((m == 3) & F.lower("text").contains("tion"), " rejected").otherwise("")
    answer = F.when(T.has_text("text"), F.concat(head, F.col("text"), tail)).otherwise(F.col("text"))
    return t.documents.select("doc_id", T.verdict(answer).alias("verdict"))


@query("l25_relative_path", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS path FROM pages")
def _l25(t):
    url = F.col("url")
    placed = F.when(F.pmod("page_id", F.lit(2)) == 0, F.concat(F.lit("/tmp/workspace_ab/"), F.regexp_replace(url, "^https?://", ""))).otherwise(url)
    return t.read("pages").select("page_id", T.relative_path(placed).alias("path"))


# -- predicates -------------------------------------------------------------------------

_changes = B._chg_list


@query("p1_state_modifying_tool", f"""SELECT event_id, tool_name IN ('Edit', 'Write') OR (tool_name = 'Bash' AND {_changes}[k % {len(B.COMMANDS)} + 1]) AS modifies FROM calls""")
def _p1(t):
    cmd = F.get_json_object("params_json", "$.command")
    return t.raw_calls.select("event_id", shell.modifies_state(F.col("tool_name"), cmd).alias("modifies"))


_FORMS = [
    ("ls && rm foo", True), ("cat foo; echo bar", False), ("ls || mkdir f", True), ("echo hi | tee o", True),
    ("cat a | sort | uniq", False), ("FOO=1 sudo ls", False), ("git branch -D x", False), ("git push", True),
    ("python -c 'open(1)'", True), ("find . -delete", True), ("sed -n p f", False), ("git log | head", True), ("make", True),
]


@query("p2_shell_command", "SELECT event_id, ([" + ", ".join(str(v).lower() for _, v in _FORMS) + f"])[k % {len(_FORMS)} + 1] AS modifies FROM calls")
def _p2(t):
    cmd = F.element_at(F.array(*[F.lit(c) for c, _ in _FORMS]), (F.pmod("k", F.lit(len(_FORMS))) + 1).cast("int"))
    return t.raw_calls.select("event_id", shell.command_modifies(F.concat(cmd, F.lit(" "))).alias("modifies"))


# Commands by what they do: read (and may stand in a pipe), read, change. Forms put two of them together.
_PIPED = ["ls -la", "cat a.txt", "head -n 5 f", "tail f", "wc -l f", "stat f", "du -sh .", "df", "tree src", "grep -rn x src", "rg x", "awk 'NR==1' f", "sort f", "uniq f", "cut -c1 f",
          "diff a b", "jq . f", "echo hi", "printf x", "pwd", "which python", "env", "whoami", "date", "test -f x", "ps aux", "/usr/bin/ls /tmp", "LS"]
_READS = ["git log", "git diff HEAD", "git status", "git branch", "git show x", "git blame f", "git stash list", "git remote -v", "git rev-parse HEAD", "git ls-files", "git fetch", "sed -n p f",
          "sed s/a/b/ f", "find . -name x", "python -c 'print(1)'", "python3 -c 'print(2)'", "node -e '1+1'"]
_CHANGES = ["rm -f x", "mv a b", "cp a b", "mkdir d", "touch f", "chmod +x f", "git add .", "git commit -m x", "git push", "git checkout b", "git reset HEAD", "git stash", "pip list", "npm run x", "make",
            "python run.py", "pytest tests", "sed -i s/a/b/ f", "sed -n -i p f", "find . -delete", "find . -exec rm {} +", "tee f", "python -c 'open(1)'", "python3 -c 'import os'", "node -e 'fs.x'", "curl x",
            "docker ps", "unknown-command"]
_EACH = _PIPED + _READS + _CHANGES
_A, _B = f"event_id % {len(_EACH)}", f"(event_id // {len(_EACH)} * 31 + event_id) % {len(_EACH)}"


@query("p2_shell_forms", f"""SELECT event_id, CASE form WHEN 0 THEN a >= {len(_PIPED + _READS)} WHEN 1 THEN a >= {len(_PIPED + _READS)} OR b >= {len(_PIPED + _READS)} WHEN 2 THEN a >= {len(_PIPED + _READS)} OR b >= {len(_PIPED + _READS)}
    WHEN 3 THEN a >= {len(_PIPED + _READS)} OR b >= {len(_PIPED + _READS)} WHEN 4 THEN a >= {len(_PIPED)} OR b >= {len(_PIPED)} WHEN 5 THEN a >= {len(_PIPED + _READS)} ELSE true END AS modifies
    FROM (SELECT event_id, event_id % 7 AS form, {_A} AS a, {_B} AS b FROM calls)""")
def _p2b(t):
    """Pairs of commands as they are, joined by &&, ||, ; and a pipe, behind assignments and sudo, and redirected."""
    each = F.array(*[F.lit(c) for c in _EACH])
    n = len(_EACH)
    a = F.element_at(each, (F.pmod("event_id", F.lit(n)) + 1).cast("int"))
    b = F.element_at(each, (F.pmod(F.floor(F.col("event_id") / n) * 31 + F.col("event_id"), F.lit(n)) + 1).cast("int"))
    form = F.pmod("event_id", F.lit(7))
    joined = lambda s: F.concat(a, F.lit(s), b)
    cmd = (F.when(form == 0, a).when(form == 1, joined(" && ")).when(form == 2, joined(" || ")).when(form == 3, joined("; ")).when(form == 4, joined(" | "))
           .when(form == 5, F.concat(F.lit("FOO=1 sudo "), a)).otherwise(F.concat(a, F.lit(" > out.txt"))))
    return t.raw_calls.select("event_id", shell.command_modifies(cmd).alias("modifies"))


@query("p3_unwrap_command", "SELECT event_id, 'run ' || k AS inner_command FROM calls")
def _p3(t):
    k = F.col("k").cast("string")
    cmd = (
        F.when(F.pmod("k", F.lit(4)) == 0, F.concat(F.lit("/bin/zsh -lc 'run "), k, F.lit("'")))
        .when(F.pmod("k", F.lit(4)) == 1, F.concat(F.lit('/bin/bash -lc "run '), k, F.lit('"')))
        .when(F.pmod("k", F.lit(4)) == 2, F.concat(F.lit("/bin/sh -c run "), k))
        .otherwise(F.concat(F.lit("run "), k)))
    return t.raw_calls.select("event_id", shell.unwrap(cmd).alias("inner_command"))


@query("p4_test_command", """SELECT event_id, tool_name = 'Bash' AND regexp_matches(tool_target, '(?i)pytest\\b|python.*-m\\s+pytest|unittest|test_|_test\\.py') AS by_regex,
    tool_name = 'Bash' AND contains(lower(tool_target), 'test') AS by_substring,
    contains(tool_target, 'pytest') OR contains(tool_target, 'unittest') OR contains(tool_target, 'tox') AS by_runner FROM calls""")
def _p4(t):
    tgt = T.target("params_json")
    return t.raw_calls.select(
        "event_id", T.is_test_command("tool_name", tgt).alias("by_regex"),
        T.is_test_command("tool_name", tgt, "substring").alias("by_substring"),
        T.is_test_command("tool_name", tgt, "runner").alias("by_runner"))


@query("p5_error_flag", """SELECT event_id, coalesce(is_error AND kind = 'whole', false) AS err_ok, is_error IS NULL OR kind = 'cut' OR (is_error AND kind = 'whole') AS err_fail,
    coalesce(is_error AND kind <> 'text', false) AS err_fallback FROM (SELECT event_id, is_error, CASE WHEN k % 7 = 1 THEN 'cut' WHEN k % 7 = 2 THEN 'text' ELSE 'whole' END AS kind FROM calls)""")
def _p5(t):
    """Some records are cut off, some carry the flag as text."""
    k = F.pmod("k", F.lit(7))
    record = F.when(k == 1, F.expr("left(result_json, length(result_json) - 1)")).when(k == 2, F.regexp_replace("result_json", "true", '"true"')).otherwise(F.col("result_json"))
    return t.raw_calls.withColumn("record", record).select(
        "event_id", T.is_error("record").alias("err_ok"), T.is_error("record", "fail").alias("err_fail"), T.is_error("record", "fallback").alias("err_fallback"))


@query("p6_target", "SELECT event_id, tool_target FROM calls")
def _p6(t):
    return t.raw_calls.select("event_id", T.target("params_json").alias("tool_target"))


@query("p7_eligible", """SELECT run_id, task_id, f_tokens FROM features
    WHERE model = 'en' AND success IS NOT NULL AND f_tokens IS NOT NULL AND task_id IN (SELECT task_id FROM runs WHERE toxic = 1)""", dbl="f_tokens")
def _p7(t):
    wanted = t.runs.where("toxic = 1").select("task_id").distinct()
    ok = t.features.where((F.col("model") == "en") & F.col("success").isNotNull() & F.col("f_tokens").isNotNull())
    return ok.join(wanted, "task_id", "left_semi").select("run_id", "task_id", "f_tokens")


@query("p8_trajectory_bin", "SELECT CASE WHEN seq <= 3 THEN 'early' WHEN seq <= 7 THEN 'mid' ELSE 'late' END AS bin, count(*) AS calls FROM calls GROUP BY 1", lng="calls")
def _p8(t):
    return t.calls.groupBy(T.trajectory_bin("seq").alias("bin")).agg(F.count(F.lit(1)).alias("calls"))


@query("p9_relative_third", """SELECT run_id, CASE WHEN (seq - 1) / n < 1 / 3.0::DOUBLE THEN 'early' WHEN (seq - 1) / n < 2 / 3.0::DOUBLE THEN 'mid' ELSE 'late' END AS third,
    count(*) AS calls, count_if(coalesce(is_error, false)) AS errors FROM calls GROUP BY ALL""", lng="calls errors")
def _p9(t):
    return t.calls.groupBy("run_id", T.trajectory_third("seq", "n").alias("third")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"))


@query("p10_first_third", "SELECT run_id, seq, seq <= greatest(1, n // 3) AS in_first_third FROM calls", lng="seq")
def _p10(t):
    return t.calls.select("run_id", "seq", T.in_first_third("seq", "n").alias("in_first_third"))
