"""Queries over the driver's tables that exercise the operators, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestar.functions import text as tx
from lodestar.operators import analytics, filtering, metrics, relations, tokens as tk
from lodestar.plans.catalog import query, read
from lodestar.sources import sampling

_LIST = ", ".join(f"'{c}'" for c in tk.CONNECTIVES)
_CLOSED = ", ".join(f"'{c}'" for c in tk.CLOSED)
_W = "w AS (SELECT doc_id, lang, source, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+') AS w FROM documents)"
_T = f"{_W}, t AS (SELECT doc_id, lang, source, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tk.tokens(_docs(spark, d), "doc_id", "lang", "source")


# --- tokens and sentences


@query("t_tokens_per_doc", f"WITH {_W} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_types FROM w WHERE w IS NOT NULL")
def _(spark, d):
    w = _docs(spark, d).filter("text is not null").select("doc_id", tx.words("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_types"))


@query("t_sentences_per_doc", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^.!?]*[A-Za-z][^.!?]*')) AS BIGINT) AS n_sentences FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(tx.sentences("text")).cast("long").alias("n_sentences"))


@query("s_asof_sentence", r"""
WITH s AS (SELECT doc_id, text, unnest(p) AS part, generate_subscripts(p, 1) AS sent_id FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]*[.!?]?') AS p FROM documents)),
o AS (SELECT doc_id, sent_id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s),
a AS (SELECT doc_id, CAST(strpos(text, 'ing') AS BIGINT) - 1 AS start FROM documents WHERE strpos(text, 'ing') > 0)
SELECT a.doc_id, a.start, CAST(max(o.sent_id) AS BIGINT) AS sent_id FROM a JOIN o ON a.doc_id = o.doc_id AND o.off <= a.start AND length(o.part) > 0 GROUP BY a.doc_id, a.start
""")
def _(spark, d):
    """The sentence that holds a character offset, the first "ing" of a text, found in the text's own array of sentence ends."""
    t = _docs(spark, d).select("doc_id", (F.instr("text", "ing") - 1).cast("long").alias("start"), F.regexp_extract_all("text", F.lit("[^.!?]*[.!?]?"), F.lit(0)).alias("p")).filter("start >= 0")
    # offsets by a running sum within the row
    ends = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")), lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.array_append(s["starts"], F.when(F.length(x) > 0, s["at"])).alias("starts")), lambda s: s["starts"])
    return t.select("doc_id", "start", ends.alias("starts")).select("doc_id", "start", F.size(F.filter("starts", lambda s: s <= F.col("start"))).cast("long").alias("sent_id"))


@query("s_span_tokens", f"""
WITH {_T}, m AS (SELECT doc_id, word, min(pos) AS first, max(pos) AS last, count(*) AS n FROM t WHERE word IN ({_LIST}) GROUP BY doc_id, word)
SELECT doc_id, word, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, n FROM m
""")
def _(spark, d):
    """Token bounds of each connective's mentions."""
    return _tokens(spark, d).filter(F.col("word").isin(list(tk.CONNECTIVES))).groupBy("doc_id", "word").agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"), F.count("*").alias("n"))


@query("s_span_bounds", """
WITH e AS (SELECT user_id, event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events)
SELECT event_type, CAST(min(event_id) AS BIGINT) AS first_id, CAST(max(event_id) AS BIGINT) AS last_id, count(*) AS n FROM e GROUP BY event_type, island
""")
def _(spark, d):
    """Runs of consecutive ids per type: a row begins a run if its predecessor isn't the id before it."""
    return analytics.runs(read(spark, d, "events").select("event_type", "event_id"), "event_id", "event_type").select("event_type", F.col("first").alias("first_id"), F.col("last").alias("last_id"), "n")


@query("s_budget_sample", """
WITH s AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM s WHERE before < 20000 GROUP BY source
""")
def _(spark, d):
    """Per source documents in order of id while the budget isn't spent; the last may overshoot."""
    s = sampling.within_budget(_docs(spark, d).select("source", "doc_id", "n_chars"), "n_chars", 20000, ["doc_id"], "source")
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@query("s_prefix_dedup", """
WITH p AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages WHERE url IS NOT NULL)
SELECT p AS path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p <> a.p AND starts_with(b.p, a.p))
""")
def _(spark, d):
    """Paths that are no prefix of another one. In sorted order a prefix stands right before a path it begins."""
    p = read(spark, d, "pages").filter("url is not null").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    # a path and what it is a prefix of have the same host, so hosts are sorted apart from each other
    return sampling.without_prefixes(p, "path", F.substring_index("path", "/", 1))


@query("s_html_fields", """
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
       CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages
""")
def _(spark, d):
    """Fields of a page that is no well-formed XML."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), n("<p>").alias("paragraphs"), n("<a href=").alias("links"))


@query("s_reject_reasons", """
WITH r AS (SELECT CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) < 200 THEN 'short' WHEN length(text) > 10000 THEN 'long' WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'noisy' ELSE 'kept' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM r GROUP BY reason
""")
def _(spark, d):
    """Documents by the first reason that rejects them."""
    t = F.col("text")
    reason = F.when(t.isNull() | (F.length(t) == 0), "empty").when(F.length(t) < 200, "short").when(F.length(t) > 10000, "long").when(t.rlike("[#*$%&]{3}"), "noisy").otherwise("kept")
    return analytics.count_by(_docs(spark, d).select(reason.alias("reason")), "reason")


@query("s_quote_offsets", """
SELECT event_id, CAST(strpos(props, ':') AS BIGINT) AS raw, CAST(strpos(props, ':') + (length(substr(props, 1, strpos(props, ':'))) - length(replace(substr(props, 1, strpos(props, ':')), '"', ''))) AS BIGINT) AS corrected FROM events WHERE strpos(props, ':') > 0
""")
def _(spark, d):
    """Offsets plus the double quotes before them."""
    e = read(spark, d, "events").filter(F.instr("props", ":") > 0)
    raw = F.instr("props", ":")
    return e.select("event_id", raw.cast("long").alias("raw"), tx.shift_by_quotes(F.col("props"), raw).cast("long").alias("corrected"))


def _rewritten(sql: str, rules) -> str:
    """The same substitutions as nested calls in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\\n", "' || chr(10) || '").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
    for pattern, by in rules:
        sql = f"regexp_replace({sql}, {quoted(pattern.replace('(?md)', '(?m)'))}, {quoted(by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return sql


_REPORT = "'A.1. ' || text || ' - said \\12\\ \"so\", (\"no\") .....' || chr(10) || 'MR. SPEAKER, OF HOUSTON' || chr(10) || 'Mr. Smith:' || chr(10) || 'well. . . . Q.3.b. word.The Next Title' || chr(10) || 'x--' || chr(10) || '   A P P E N D I X' || chr(10) || text"


@query("s_cleanup", f"""
WITH r AS (SELECT doc_id, {_REPORT} AS t FROM documents), b AS (SELECT doc_id, substr(t, 1, strpos(t, '   A P P E N D I X') - 1) AS t FROM r)
SELECT doc_id, md5({_rewritten("t", tx.CLEANUP_RULES)}) AS cleaned, md5({_rewritten("t", tx.QUOTE_RULES)}) AS quoted FROM b
""")
def _(spark, d):
    """All rewriting rules on each text with the marks of a report around it, up to its appendix."""
    t = F.expr(_REPORT.replace("chr(10)", "'\\n'").replace("\\12\\", "\\\\12\\\\"))
    r = _docs(spark, d).select("doc_id", tx.before_appendix(t).alias("t"))
    return r.select("doc_id", F.md5(tx.rewrite("t", tx.CLEANUP_RULES)).alias("cleaned"), F.md5(tx.rewrite("t", tx.QUOTE_RULES)).alias("quoted"))


# --- connectives


@query("c_connective_counts", f"WITH {_T} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE word IN ({_LIST}) GROUP BY word")
def _(spark, d):
    per = _tokens(spark, d).filter(F.col("word").isin(list(tk.CONNECTIVES))).groupBy("word", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


_PHRASES = "CASE word WHEN 'to' THEN 'Thank to' WHEN 'for' THEN 'for too' WHEN 'as' THEN 'be so' WHEN 'by' THEN 'reason be' WHEN 'in' THEN 'On grounds that' WHEN 'of' THEN 'result of' WHEN 'from' THEN 'on grounds of' ELSE word END"


def _case(name: str, mapping: dict[str, str]) -> str:
    return f"CASE {name} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items())} ELSE {name} END"


@query("c_connective_remap", f"""
WITH {_T}, p AS (SELECT {_PHRASES} AS p FROM t WHERE word IN ({_LIST}))
SELECT CASE WHEN starts_with(p, 'be ') THEN substr(p, 4) ELSE {_case('p', relations.REMAPS)} END AS agreement, {_case('lower(p)', relations.CORPUS_REMAPS)} AS corpus, count(*) AS n FROM p GROUP BY 1, 2
""")
def _(spark, d):
    """Both tables of names, on connectives made phrases."""
    p = _tokens(spark, d).filter(F.col("word").isin(list(tk.CONNECTIVES))).select(F.expr(_PHRASES).alias("p"))
    return analytics.count_by(p.select(relations.remapped_connective("p").alias("agreement"), relations.corpus_connective("p").alias("corpus")), "agreement", "corpus")


@query("p_lemma_prefilter", f"WITH {_W} SELECT doc_id FROM w WHERE list_has_all(w, ['from', 'the', 'to'])")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.words("text").alias("w")).filter(tk.contains_all("w", ["from", "the", "to"])).select("doc_id")


@query("r_candidates", f"""
WITH {_T}, f AS (SELECT doc_id, pos FROM t WHERE word = 'from'), o AS (SELECT doc_id, pos FROM t WHERE word = 'to')
SELECT f.doc_id, CAST(f.pos AS BIGINT) AS pos, CAST(min(o.pos - f.pos) AS BIGINT) AS gap FROM f JOIN o ON o.doc_id = f.doc_id AND o.pos > f.pos AND o.pos <= f.pos + 9 GROUP BY f.doc_id, f.pos
""")
def _(spark, d):
    w = _docs(spark, d).select("doc_id", tx.words("text").alias("w"))
    return w.select("doc_id", F.explode(tk.gapped("w", "from", "to", 8)).alias("g")).select("doc_id", "g.pos", "g.gap")


@query("b_content_pairs", f"""
WITH {_T}, c AS (SELECT doc_id, pos, word FROM t WHERE word IN ({_LIST})),
a AS (SELECT c.doc_id, c.pos, max(t.pos) AS p FROM c JOIN t ON t.doc_id = c.doc_id AND t.pos BETWEEN c.pos - 3 AND c.pos - 1 AND t.word NOT IN ({_CLOSED}) GROUP BY c.doc_id, c.pos),
b AS (SELECT c.doc_id, c.pos, min(t.pos) AS p FROM c JOIN t ON t.doc_id = c.doc_id AND t.pos BETWEEN c.pos + 1 AND c.pos + 3 AND t.word NOT IN ({_CLOSED}) GROUP BY c.doc_id, c.pos)
SELECT x.word AS a, c.word AS conn, y.word AS b, count(*) AS n FROM c JOIN a USING (doc_id, pos) JOIN b USING (doc_id, pos)
JOIN t x ON x.doc_id = c.doc_id AND x.pos = a.p JOIN t y ON y.doc_id = c.doc_id AND y.pos = b.p GROUP BY 1, 2, 3
""")
def _(spark, d):
    return analytics.count_by(tk.content_pairs(_docs(spark, d), 3), "a", "conn", "b")


@query("b_majority_rule", """
SELECT event_type, user_id % 50 AS bucket, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS pos, CAST(count(*) FILTER (WHERE NOT value > 50) AS BIGINT) AS neg,
       count(*) FILTER (WHERE value > 50) > count(*) FILTER (WHERE NOT value > 50) AS predicted FROM events GROUP BY 1, 2
""")
def _(spark, d):
    e = read(spark, d, "events").withColumn("bucket", F.col("user_id") % 50)
    return filtering.majority(e, ["event_type", "bucket"], F.col("value") > 50)


@query("b_union_antijoin", f"""
WITH {_T}, m AS (SELECT DISTINCT doc_id, word FROM t WHERE word IN ('to', 'for')), b AS (SELECT DISTINCT doc_id, word FROM t WHERE word IN ('for', 'by'))
SELECT doc_id, word, 'pipeline' AS origin FROM m UNION ALL SELECT doc_id, word, 'baseline' FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = b.doc_id AND m.word = b.word)
""")
def _(spark, d):
    """A pipeline's rows, and those of the baseline that it doesn't have."""
    t = _tokens(spark, d)
    pick = lambda *x: t.filter(F.col("word").isin(*x)).select("doc_id", "word").distinct()
    main, base = pick("to", "for"), pick("for", "by")
    return main.withColumn("origin", F.lit("pipeline")).unionByName(base.join(main, ["doc_id", "word"], "left_anti").withColumn("origin", F.lit("baseline")))


# --- filters


@query("f_prior_filter", """
WITH r AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT source, avg(quality) AS prior FROM r GROUP BY source)
SELECT doc_id, source, round(prior, 6) AS score FROM r JOIN p USING (source) WHERE prior > 0.45
""")
def _(spark, d):
    r = _docs(spark, d).select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return filtering.prior_filter(r, filtering.prior(r, "source", "quality"), "source").select("doc_id", "source", F.round("score", 6).alias("score"))


_CANDIDATES = f"""{_T}, c AS (SELECT doc_id, pos, word, CASE WHEN word IN ('of', 'in') THEN [pos, pos + 1] WHEN word IN ('to', 'for') THEN [pos - 1, pos, pos + 1] ELSE [pos, pos + 1, pos + 2, pos + 3] END AS tok FROM t WHERE word IN ({_LIST}))"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Word windows around connectives as stand-ins for candidates, which overlap where connectives are close."""
    p = F.col("pos").cast("long")
    near = lambda *o: F.array(*[p + x for x in o])
    tok = F.when(F.col("word").isin("of", "in"), near(0, 1)).when(F.col("word").isin("to", "for"), near(-1, 0, 1)).otherwise(near(0, 1, 2, 3))
    return _tokens(spark, d).filter(F.col("word").isin(list(tk.CONNECTIVES))).select("doc_id", p.alias("cand_id"), "word", tok.alias("tok"))


@query("f_overlap_conflicts", f"""
WITH {_CANDIDATES}, u AS (SELECT doc_id, pos, word, unnest(tok) AS x FROM c), n AS (SELECT doc_id, x FROM u GROUP BY doc_id, x HAVING count(*) > 1),
bad AS (SELECT DISTINCT u.doc_id, u.pos FROM u JOIN n USING (doc_id, x) WHERE u.word IN ('of', 'in', 'as'))
SELECT c.doc_id, CAST(c.pos AS BIGINT) AS cand_id, c.word FROM c WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = c.doc_id AND bad.pos = c.pos)
""")
def _(spark, d):
    c = _candidates(spark, d).withColumn("steiner", F.col("word").isin("of", "in", "as"))
    return filtering.conflicts(c, ["doc_id"], "tok", "steiner").select("doc_id", "cand_id", "word")


@query("f_keep_larger")
def _(spark, d):
    """F14 in each document; sequential, so no plain SQL: the tests hold it against brute force."""
    return filtering.keep_larger(_candidates(spark, d), ["doc_id"], "tok", "cand_id").select("doc_id", "cand_id", "word")


@query("f_soft_vote", """
WITH g AS (SELECT avg(quality) AS g FROM labels), m AS (SELECT toxic, avg(quality) AS m FROM labels GROUP BY toxic)
SELECT doc_id, round((g + coalesce(m, 0) + coalesce(CAST(quality AS DOUBLE), 0)) / (1 + (m IS NOT NULL)::INT + (quality IS NOT NULL)::INT), 6) AS vote FROM labels JOIN g ON true LEFT JOIN m ON m.toxic IS NOT DISTINCT FROM labels.toxic
""")
def _(spark, d):
    l = read(spark, d, "labels")
    g = l.agg(F.avg("quality").alias("g"))
    m = l.groupBy("toxic").agg(F.avg("quality").alias("m")).withColumnRenamed("toxic", "t")
    rows = l.crossJoin(g).join(m, F.col("toxic").eqNullSafe(F.col("t")), "left")  # g is one row
    return rows.select("doc_id", F.round(filtering.soft_vote(["g", "m", F.col("quality").cast("double")]), 6).alias("vote"))


@query("f_chi2_topk", f"""
WITH {_T}, l AS (SELECT DISTINCT t.doc_id, word, quality = 1 AS y FROM t JOIN labels ON labels.doc_id = t.doc_id),
n AS (SELECT word, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b FROM l GROUP BY word),
z AS (SELECT CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE NOT y) AS DOUBLE) AS q FROM (SELECT DISTINCT doc_id, y FROM l))
SELECT word, a, b, round(coalesce((p + q) * pow(a * (q - b) - b * (p - a), 2) / nullif((a + b) * (p + q - a - b) * p * q, 0), 0), 6) AS chi2 FROM n, z ORDER BY round(chi2, 6) DESC, word LIMIT 50
""")
def _(spark, d):
    labelled = _docs(spark, d).join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    t = labelled.select("doc_id", "quality", F.explode(F.array_distinct(tx.words("text"))).alias("word"))
    chi = filtering.chi_square(t, "word", F.col("quality") == 1).withColumn("chi2", F.round("chi2", 6))
    return filtering.top(chi, "chi2", 50, "word")


# --- features


@query("x_skipgrams", f"""
WITH {_T}, g AS (SELECT a.doc_id, a.word || ' ' || b.word AS gram FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos - a.pos IN (1, 2)) SELECT gram, count(*) AS n FROM g GROUP BY gram
""")
def _(spark, d):
    w = _docs(spark, d).select("doc_id", tx.words("text").alias("w"))
    return analytics.count_by(tk.skipgrams(w, "w"), "gram")


@query("x_skipgrams_thresholded", f"""
WITH {_T}, g AS (SELECT a.doc_id, a.word || ' ' || b.word AS gram FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos - a.pos IN (1, 2))
SELECT gram, count(DISTINCT doc_id) AS holders, count(*) AS n FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 4
""")
def _(spark, d):
    w = _docs(spark, d).select("doc_id", tx.words("text").alias("w"))
    return tk.thresholded_rows(w, "w")


@query("x_closed_class", f"WITH {_W} SELECT doc_id, array_to_string(list_filter(w, lambda x: x IN ({_CLOSED})), ' ') AS closed FROM w WHERE w IS NOT NULL")
def _(spark, d):
    w = _docs(spark, d).filter("text is not null").select("doc_id", tx.words("text").alias("w"))
    return w.select("doc_id", F.array_join(F.filter("w", lambda x: x.isin(list(tk.CLOSED))), " ").alias("closed"))


_S = r"s AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS sent_id FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[A-Za-z][^.!?]*') AS p FROM documents)), sw AS (SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id, part, regexp_extract_all(lower(regexp_replace(part, '[^A-Za-z]', ' ', 'g')), '[a-z]+') AS w FROM s)"


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tk.sentence_table(_docs(spark, d), "doc_id")
    return s.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), "text", tx.words("text").alias("w"))


@query("x_prep_start", f"WITH {_S} SELECT CASE WHEN w[1] IN ('as', 'by', 'for', 'from', 'in', 'of', 'with') THEN w[1] ELSE 'None' END AS start, count(*) AS n FROM sw GROUP BY 1")
def _(spark, d):
    first = F.get("w", F.lit(0))
    return analytics.count_by(_sentences(spark, d).select(F.when(first.isin("as", "by", "for", "from", "in", "of", "with"), first).otherwise("None").alias("start")), "start")


@query("x_comp_start", f"WITH {_S} SELECT doc_id, CAST(count(*) FILTER (WHERE w[1] IN ('for', 'that', 'to')) AS BIGINT) AS n_comp, count(*) AS n FROM sw GROUP BY doc_id")
def _(spark, d):
    return _sentences(spark, d).groupBy("doc_id").agg(F.count_if(F.get("w", F.lit(0)).isin(list(tk.COMPLEMENT))).alias("n_comp"), F.count("*").alias("n"))


@query("x_commas_between", f"""
WITH {_S}, x AS (SELECT doc_id, sent_id, regexp_extract(part, '\\b(in|of|to|for)\\b.*?\\b(the|and|a)\\b') AS m FROM sw) SELECT doc_id, sent_id, CAST(length(m) - length(replace(m, ',', '')) AS BIGINT) AS commas FROM x WHERE m <> ''
""")
def _(spark, d):
    """Commas between a connective and the next determiner or conjunction of its sentence."""
    m = F.regexp_extract("text", r"\b(in|of|to|for)\b.*?\b(the|and|a)\b", 0)
    return _sentences(spark, d).select("doc_id", "sent_id", m.alias("m")).filter("m <> ''").select("doc_id", "sent_id", tx.count_of(F.col("m"), ",").cast("long").alias("commas"))


@query("x_words_between", f"WITH {_W} SELECT doc_id, CAST(least(abs(list_position(w, 'the') - list_position(w, 'of')) - 1, 10) AS BIGINT) AS between_ FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def _(spark, d):
    """Words between two heads, at most 10."""
    w = _docs(spark, d).select("doc_id", tx.words("text").alias("w")).select("doc_id", F.array_position("w", "the").alias("a"), F.array_position("w", "of").alias("b"))
    return w.filter("a > 0 and b > 0").select("doc_id", F.least(F.abs(F.col("a") - F.col("b")) - 1, F.lit(10)).cast("long").alias("between_"))


@query("x_rel_pos", f"""
WITH {_T}, a AS (SELECT doc_id, min(pos) AS f, max(pos) AS l FROM t WHERE word = 'from' GROUP BY doc_id), b AS (SELECT doc_id, min(pos) AS f, max(pos) AS l FROM t WHERE word = 'with' GROUP BY doc_id)
SELECT doc_id, CASE WHEN a.l < b.f THEN 'Before' WHEN a.f > b.l THEN 'After' ELSE 'Overlapping' END AS rel FROM a JOIN b USING (doc_id)
""")
def _(spark, d):
    """Where the span of one word's mentions lies to that of another's."""
    t = _tokens(spark, d).filter(F.col("word").isin("from", "with")).groupBy("doc_id").agg(*[f(F.when(F.col("word") == w, F.col("pos"))).alias(n) for w, p in (("from", "a"), ("with", "b")) for f, n in ((F.min, f"{p}f"), (F.max, f"{p}l"))])
    return t.filter("af is not null and bf is not null").select("doc_id", tx.relative_position(*[F.col(c) for c in ("af", "al", "bf", "bl")]).alias("rel"))


_PAIRS = "p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.lead("embedding").over(w).alias("b")).filter("b is not null")


@query("x_vector_dist", f"WITH {_PAIRS} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 4) AS dist FROM p WHERE b IS NOT NULL")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(tx.distance("a", "b"), 4).alias("dist"))


@query("x_vector_cos", f"""
WITH {_PAIRS} SELECT vec_id, round(1 - list_sum(list_transform(list_zip(a, b), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) /
  (sqrt(list_sum(list_transform(a, lambda x: pow(CAST(x AS DOUBLE), 2)))) * sqrt(list_sum(list_transform(b, lambda x: pow(CAST(x AS DOUBLE), 2))))), 4) AS dist FROM p WHERE b IS NOT NULL
""")
def _(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(tx.cosine_distance("a", "b"), 4).alias("dist"))


@query("x_log_bins", "SELECT CAST(round(ln(10 * (o_totalprice + 1))) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return analytics.count_by(read(spark, d, "orders").select(tx.log_bin("o_totalprice").alias("bin")), "bin")


@query("x_conjoined_features", "SELECT l_returnflag || ':' || l_linestatus AS feature, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return analytics.count_by(read(spark, d, "lineitem").select(F.concat_ws(":", "l_returnflag", "l_linestatus").alias("feature")), "feature")


# --- metrics

_PRF = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1"""
_COUNTS = "SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source"


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    r = _docs(spark, d).select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return metrics.classification(r, F.col("quality") == 1, F.col("toxic") == 1, "source")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("m_prf_by_source", f"WITH c AS ({_COUNTS}) SELECT source, {_PRF} FROM c")
def _(spark, d):
    return _rounded(_by_source(spark, d))


@query("m_prf_micro_macro", f"""
WITH c AS ({_COUNTS}), s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c),
m AS (SELECT tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f FROM c)
SELECT 'micro' AS average, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM s
UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m
""")
def _(spark, d):
    c = _by_source(spark, d)
    pick = lambda n, x: _rounded(x.select(F.lit(n).alias("average"), "precision", "recall", "f1"))
    return pick("micro", metrics.micro(c)).unionByName(pick("macro", metrics.macro(c)))


@query("m_confusion", "SELECT quality AS gold, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return metrics.confusion(read(spark, d, "labels"), "quality", "toxic")


@query("m_accuracy_kappa", """
WITH m AS (SELECT quality AS g, toxic AS p, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) FILTER (WHERE g = p) AS DOUBLE) AS s FROM m),
e AS (SELECT sum(CAST(a.n AS DOUBLE) * b.n) AS e FROM (SELECT g, sum(n) AS n FROM m GROUP BY g) a JOIN (SELECT p, sum(n) AS n FROM m GROUP BY p) b ON a.g = b.p)
SELECT CAST(n AS BIGINT) AS n, round(s / n, 6) AS accuracy, round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e
""")
def _(spark, d):
    return _rounded(metrics.kappa(metrics.confusion(read(spark, d, "labels"), "quality", "toxic")))


_B = "b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z]', ' ', 'g')), '[a-z]+')) AS v FROM benchmark), nb AS (SELECT item_id, v, lead(v) OVER (ORDER BY item_id) AS u FROM b)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's words beside those of the next item."""
    b = read(spark, d, "benchmark").select("item_id", F.array_distinct(tx.words("text")).alias("v"))
    b = b.withColumn("cell", F.floor(F.col("item_id") / 1000)).withColumn("first", F.expr("item_id % 1000 = 0"))
    w = Window.partitionBy("cell").orderBy("item_id")
    nxt = b.filter("first").select((F.col("cell") - 1).alias("cell"), F.col("v").alias("n"))
    return b.withColumn("u", F.lead("v").over(w)).join(nxt, "cell", "left").select("item_id", "v", F.coalesce("u", "n").alias("u")).filter("u is not null")


@query("m_jaccard", f"WITH {_B} SELECT item_id, round(len(list_intersect(v, u))::DOUBLE / len(list_distinct(list_concat(v, u))), 6) AS jaccard FROM nb WHERE u IS NOT NULL")
def _(spark, d):
    return _items(spark, d).select("item_id", F.round(metrics.jaccard("v", "u"), 6).alias("jaccard"))


@query("m_partial_overlap", f"WITH {_B} SELECT item_id, CAST(len(list_intersect(v, u)) AS BIGINT) AS shared, len(list_intersect(v, u)) > 0.2 * greatest(len(v), len(u)) AS partial FROM nb WHERE u IS NOT NULL")
def _(spark, d):
    return _items(spark, d).select("item_id", F.size(F.array_intersect("v", "u")).cast("long").alias("shared"), metrics.partial_span("v", "u", 0.2).alias("partial"))


@query("m_fold_assignment", "SELECT CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 20 AS INTEGER) AS fold, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def _(spark, d):
    """M19."""
    return _docs(spark, d).groupBy(filtering.folds("doc_id").alias("fold")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("m_annotator_pairs", """
WITH r AS (SELECT DISTINCT role FROM conversations), p AS (SELECT a.role AS a, b.role AS b FROM r a JOIN r b ON a.role < b.role), x AS (SELECT DISTINCT conv_id, role FROM conversations)
SELECT p.a, p.b, count(*) AS shared FROM p JOIN x s ON s.role = p.a JOIN x t ON t.role = p.b AND t.conv_id = s.conv_id GROUP BY 1, 2
""")
def _(spark, d):
    """Pairs of annotators (roles) and what both have annotated."""
    x = read(spark, d, "conversations").select("conv_id", "role").distinct()
    p = metrics.pairs_of(x, "role")
    return p.join(x.withColumnRenamed("role", "a"), "a").join(x.withColumnRenamed("role", "b"), ["b", "conv_id"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


@query("m_latex", f"WITH c AS ({_COUNTS}) SELECT source, format('{{:.3f}} & {{:.3f}} \\\\', round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 3), round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 3)) AS line FROM c")
def _(spark, d):
    r = _by_source(spark, d).fillna(0.0, ["precision", "recall"])
    return r.select("source", metrics.latex_row(["precision", "recall"]).alias("line"))


# --- analytics


@query("c_count_where", "SELECT count(*) FILTER (WHERE n_chars > 1000 AND lang = 'en') AS n FROM documents")
def _(spark, d):
    return analytics.count_where(_docs(spark, d), (F.col("n_chars") > 1000) & (F.col("lang") == "en"))


@query("c_type_sets", """
WITH s AS (SELECT conv_id, string_agg(DISTINCT role, '+' ORDER BY role) AS types FROM conversations GROUP BY conv_id) SELECT types, count(*) AS n FROM s GROUP BY types
""")
def _(spark, d):
    return analytics.type_sets(read(spark, d, "conversations"), ["conv_id"], "role")


@query("c_entropy", f"""
WITH {_T}, c AS (SELECT lang, word, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT lang, sum(n) AS s FROM c GROUP BY lang)
SELECT lang, round(-sum(n / s * log2(n / s)), 4) AS entropy FROM c JOIN s USING (lang) GROUP BY lang
""")
def _(spark, d):
    e = analytics.entropy(analytics.count_by(_tokens(spark, d), "lang", "word"), "n", "lang")
    return e.select("lang", F.round("entropy", 4).alias("entropy"))


@query("c_binary_entropy", f"""
WITH {_T}, c AS (SELECT word, count(*) AS possible, count(*) FILTER (WHERE source IN ('src1', 'src2', 'src3')) AS yes FROM t WHERE word IN ({_LIST}) GROUP BY word), p AS (SELECT word, yes / greatest(yes, possible)::DOUBLE AS p FROM c)
SELECT word, round(CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END, 6) AS entropy FROM p
""")
def _(spark, d):
    c = _tokens(spark, d).filter(F.col("word").isin(list(tk.CONNECTIVES))).groupBy("word").agg(F.count("*").alias("possible"), F.count_if(F.col("source").isin("src1", "src2", "src3")).alias("yes"))
    return c.select("word", F.round(analytics.binary_entropy(F.col("yes"), F.col("possible")), 6).alias("entropy"))


@query("c_length_median", f"WITH {_W} SELECT lang, median(len(w)) AS med FROM w WHERE w IS NOT NULL GROUP BY lang")
def _(spark, d):
    return _docs(spark, d).filter("text is not null").select("lang", F.size(tx.words("text")).alias("n")).groupBy("lang").agg(F.median("n").alias("med"))


@query("c_length_hist", f"WITH {_S} SELECT CAST(least(len(w), 21) AS BIGINT) AS bin, count(*) AS n FROM sw WHERE len(w) >= 1 GROUP BY 1")
def _(spark, d):
    return analytics.histogram(_sentences(spark, d), F.size("w"), 21)


_STEPS = f"""{_T}, f AS (SELECT word, min(doc_id % 20) AS step FROM t GROUP BY word), n AS (SELECT step, count(*) AS new FROM f GROUP BY step),
c AS (SELECT step, CAST(sum(coalesce(new, 0)) OVER (ORDER BY step) AS BIGINT) AS seen FROM (SELECT DISTINCT doc_id % 20 AS step FROM documents) LEFT JOIN n USING (step))"""


def _saturation(spark: SparkSession, d: str) -> DataFrame:
    first = _tokens(spark, d).groupBy("word").agg(F.min(F.col("doc_id") % 20).alias("step"))
    return analytics.saturation(first, _docs(spark, d).select((F.col("doc_id") % 20).alias("step")).distinct())


@query("c_saturation", f"WITH {_STEPS} SELECT step, seen FROM c")
def _(spark, d):
    return _saturation(spark, d)


@query("c_saturation_fit")
def _(spark, d):
    """C09's curve fit; the tests hold it against numpy's least squares."""
    return analytics.fit_log_square(_saturation(spark, d).withColumn("x", F.col("step") + 1), "x", "seen")


@query("c_type_cube", """
SELECT CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, CASE WHEN grouping(quality) = 1 THEN '*' ELSE CAST(quality AS VARCHAR) END AS quality, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (source, quality)
""")
def _(spark, d):
    r = _docs(spark, d).select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return analytics.cross_tab(r, "source", "quality")


@query("c_path_spread", """
WITH c AS (SELECT event_type, user_id % 10 AS p, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, sum(n) AS s FROM c GROUP BY 1), e AS (SELECT event_type, -sum(n / s * log2(n / s)) AS h FROM c JOIN s USING (event_type) GROUP BY 1)
SELECT event_type, round(stddev_pop(value), 4) AS length_std, round(any_value(h), 4) AS entropy FROM events JOIN e USING (event_type) GROUP BY 1
""")
def _(spark, d):
    r = analytics.diversity(read(spark, d, "events").withColumn("p", F.col("user_id") % 10), "event_type", "p", "value")
    return r.select("event_type", F.round("length_std", 4).alias("length_std"), F.round("entropy", 4).alias("entropy"))


@query("c_per_connective", f"""
WITH {_T}, g AS (SELECT a.word AS connective, b.word AS pattern FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.word IN ({_LIST}))
SELECT connective, count(DISTINCT pattern) AS patterns, count(*) AS instances FROM g GROUP BY connective
""")
def _(spark, d):
    w = _docs(spark, d).select(tx.words("text").alias("w"))
    g = w.select(F.explode(tk.ngrams("w", 1)).alias("g")).select(F.col("g.a").alias("connective"), F.col("g.b").alias("pattern")).filter(F.col("connective").isin(list(tk.CONNECTIVES)))
    return analytics.per_connective(g, "connective", "pattern")


@query("c_precision_by", "SELECT source, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(spark, d):
    r = _docs(spark, d).select("doc_id", "source").join(read(spark, d, "labels"), "doc_id")
    return analytics.precision_by(r, "source", "quality").withColumn("precision", F.round("precision", 6))
