"""Stand-off annotations: reader and writer.

Lines become tables by kind; references are resolved by joins, so that their order in the file doesn't matter, and what
refers to nothing is reported in a table of warnings. Where a role is given twice, the last line wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestar.functions.text import shift_by_quotes
from lodestar.plans.staging import staged
from lodestar.schema import BINARY_DEGREES, CAUSAL_TYPES, DEGREES, OVERLAPPING_TYPES
from lodestar.sources.parses import files

_FRAGMENTS = "array<struct<start:int,end:int>>"


def annotation_lines(spark: SparkSession, folder: str, recurse: bool = False) -> DataFrame:
    """(doc_id, line_no, line) of all annotation files; an empty file gives no rows."""
    f = files(spark, folder, "*.ann", recurse)
    return f.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


def tables(lines: DataFrame) -> dict[str, DataFrame]:
    """Spans, events, attributes, corefs and warnings from (doc_id, line_no, line) rows."""
    f = F.split("line", "\t")
    base = lines.select("doc_id", "line_no", "line", f.alias("f"), F.get(f, F.lit(0)).alias("id"), F.substring("line", 1, 1).alias("kind"), F.size(f).alias("n"))
    body = F.split(F.get("f", F.lit(1)), " ")
    coref = F.get("f", F.lit(1)).startswith("Coref")
    parts = F.split(F.regexp_replace(F.get("f", F.lit(1)), r"^\S+\s", ""), ";")
    well_cut = F.forall(parts, lambda p: p.rlike(r"^\d+ \d+$"))
    span_ok = (F.col("n") == 3) & well_cut
    fragments = F.transform(parts, lambda p: F.struct(F.try_element_at(F.split(p, " "), F.lit(1)).cast("int").alias("start"), F.try_element_at(F.split(p, " "), F.lit(2)).cast("int").alias("end")))
    t = base.filter("kind = 'T'")
    spans = t.filter(span_ok).select("doc_id", "line_no", F.col("id").alias("ann_id"), F.get(body, F.lit(0)).alias("ann_type"), fragments.cast(_FRAGMENTS).alias("frags"), F.get("f", F.lit(2)).alias("text"))
    e = base.filter((F.col("kind") == "E") & ~F.coalesce(coref, F.lit(False)))
    event_ok = (F.col("n") == 2) & (F.size(body) >= 2) & F.forall(body, lambda x: F.size(F.split(x, ":")) == 2)
    pair = lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).alias("role"), F.get(F.split(x, ":"), F.lit(1)).alias("target"))
    known = F.get(F.split(F.get(body, F.lit(0)), ":"), F.lit(0)).isin(*CAUSAL_TYPES, "NonCausal")
    events = e.filter(event_ok).filter(known).select("doc_id", "line_no", F.col("id").alias("event_id"), F.get(F.split(F.get(body, F.lit(0)), ":"), F.lit(0)).alias("event_type"), F.get(F.split(F.get(body, F.lit(0)), ":"), F.lit(1)).alias("trigger_id"), F.transform(F.slice(body, 2, 1000), pair).alias("roles"))
    a = base.filter((F.col("kind") == "A") & (F.col("n") == 2))
    attributes = a.select("doc_id", "line_no", F.col("id").alias("attr_id"), F.regexp_replace(F.get(body, F.lit(0)), "-", "_").alias("name"), F.get(body, F.lit(1)).alias("target_id"), F.get(body, F.lit(2)).alias("value"))
    attr_ok = F.when(F.col("name") == "Degree", F.coalesce(F.col("value").isin(*DEGREES), F.lit(False))).otherwise(F.col("name").isin(*OVERLAPPING_TYPES) & F.col("value").isNull())
    corefs = base.filter(coref).select("doc_id", "line_no", F.regexp_extract("line", r"Arg1:(\S+)", 1).alias("from_id"), F.regexp_extract("line", r"Arg2:(\S+)", 1).alias("to_id"))
    warn = lambda df, why: df.select("doc_id", "line_no", F.lit(why).alias("reason"))
    ids = spans.select("doc_id", F.col("ann_id").alias("target"))
    named = ids.unionByName(events.select("doc_id", F.col("event_id").alias("target")))
    refs = events.select("doc_id", "line_no", F.explode(F.array_append(F.col("roles.target"), F.col("trigger_id"))).alias("target"))
    warnings = (
        warn(t.filter(~F.coalesce(span_ok, F.lit(False))), "malformed span").unionByName(warn(e.filter(~F.coalesce(event_ok, F.lit(False))), "malformed event"))
        .unionByName(warn(e.filter(event_ok).filter(~known), "unknown event type")).unionByName(warn(attributes.filter(~attr_ok), "invalid attribute"))
        .unionByName(warn(base.filter((F.col("kind") == "A") & (F.col("n") != 2)), "malformed attribute"))
        .unionByName(warn(base.filter(~F.col("kind").isin("T", "E", "A", "#") & ~F.coalesce(coref, F.lit(False))), "unknown line"))
        .unionByName(warn(refs.join(ids, ["doc_id", "target"], "left_anti").distinct(), "undefined id"))
        .unionByName(warn(attributes.filter(attr_ok).withColumnRenamed("target_id", "target").join(named, ["doc_id", "target"], "left_anti"), "undefined id"))
    )
    return {"spans": spans, "events": events, "attributes": attributes.filter(attr_ok), "corefs": corefs, "warnings": warnings}


def unused_arguments(t: dict[str, DataFrame]) -> DataFrame:
    """Argument spans that no event and no coreference target uses."""
    used = t["events"].select("doc_id", F.explode("roles.target").alias("ann_id")).unionByName(t["corefs"].select("doc_id", F.col("to_id").alias("ann_id")))
    return t["spans"].filter("ann_type = 'Argument'").join(used, ["doc_id", "ann_id"], "left_anti").select("doc_id", "ann_id", "text")


def locate(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, ann_id, sent_id, tokens): the sentence where a span starts, and its tokens there.

    A token belongs to a span that overlaps it; one that only touches the start counts if no token starts there. The window is
    the span's own sentence, found as the last one that starts at or before it.
    """
    s = sentences.select("doc_id", "sent_id", "start", "end", "tokens")
    following = s.withColumn("next", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("sent_id")), F.col("end")))
    none = lambda t: F.lit(None).cast(t)
    starts = following.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("sent_id", "next").alias("s"), none("string").alias("ann_id"), none(_FRAGMENTS).alias("frags"))
    at = spans.select("doc_id", F.get("frags", F.lit(0))["start"].alias("at"), F.lit(1).alias("kind"), none("struct<sent_id:int,next:int>").alias("s"), "ann_id", "frags")
    # the last sentence that starts at or before a span: sorted together, not every sentence of a document with every span
    before = Window.partitionBy("doc_id").orderBy("at", "kind", "s.sent_id").rowsBetween(Window.unboundedPreceding, 0)
    asof = starts.unionByName(at).withColumn("s", F.last("s", ignorenulls=True).over(before)).filter((F.col("kind") == 1) & (F.col("at") < F.col("s.next")))
    inside = asof.select("doc_id", F.col("s.sent_id").alias("sent_id"), "ann_id", "frags").join(s.select("doc_id", "sent_id", "tokens"), ["doc_id", "sent_id"])
    real = F.filter("tokens", lambda t: t["start"].isNotNull())
    overlaps = lambda t: F.exists("frags", lambda f: (t["start"] < f["end"]) & (t["end"] > f["start"]))
    touches = lambda t: F.exists("frags", lambda f: (t["end"] == f["start"]) & ~F.exists(real, lambda o: (o["start"] <= f["start"]) & (o["end"] > f["start"])))
    hit = F.transform(F.filter(real, lambda t: overlaps(t) | touches(t)), lambda t: t["idx"])
    return inside.select("doc_id", "ann_id", "sent_id", F.array_sort(hit).alias("tokens"))


def instances(t: dict[str, DataFrame], sentences: DataFrame, binarize: bool = True, ignore_overlapping: bool = False) -> DataFrame:
    """Relation instances with argument token arrays (INSTANCE)."""
    placed = locate(t["spans"], sentences)
    triggers = t["spans"].filter(F.col("ann_type").isin(*CAUSAL_TYPES, "NonCausal", *OVERLAPPING_TYPES)).select("doc_id", "ann_id", "ann_type")
    conn = triggers.join(placed, ["doc_id", "ann_id"]).select("doc_id", F.col("ann_id").alias("trigger_id"), "ann_type", "sent_id", F.col("tokens").alias("connective"))
    last = t["events"].select("doc_id", "trigger_id", F.struct("line_no", "event_id", "event_type").alias("e")).groupBy("doc_id", "trigger_id").agg(F.max("e").alias("e"))
    conn = conn.join(last, ["doc_id", "trigger_id"], "left")
    # a digit behind a role's name only tells it from others of that name
    roles = t["events"].select("doc_id", "trigger_id", "line_no", F.posexplode("roles").alias("k", "r")).select("doc_id", "trigger_id", "line_no", "k", F.lower(F.regexp_replace("r.role", r"\d$", "")).alias("role"), F.col("r.target").alias("ann_id"))
    filled = roles.join(placed.select("doc_id", "ann_id", "tokens"), ["doc_id", "ann_id"]).groupBy("doc_id", "trigger_id").agg(
        *[F.max_by(F.when(F.col("role") == r, F.col("tokens")), F.when(F.col("role") == r, F.struct("line_no", "k"))).alias(r) for r in ("cause", "effect", "means")]
    )
    attrs = t["attributes"].join(t["events"].select("doc_id", F.col("event_id").alias("target_id"), "trigger_id"), ["doc_id", "target_id"], "left").withColumn("trigger_id", F.coalesce("trigger_id", "target_id"))
    flat = [F.lit(x) for pair in BINARY_DEGREES.items() for x in pair]
    degree = F.coalesce(F.create_map(*flat)[F.col("value")], F.col("value")) if binarize else F.col("value")
    attrs = attrs.groupBy("doc_id", "trigger_id").agg(F.max_by(F.when(F.col("name") == "Degree", degree), F.when(F.col("name") == "Degree", F.col("line_no"))).alias("degree"), F.array_sort(F.collect_set(F.when(F.col("name") != "Degree", F.col("name")))).alias("extra"))
    all_ = conn.join(filled, ["doc_id", "trigger_id"], "left").join(attrs, ["doc_id", "trigger_id"], "left")
    causal = F.col("ann_type").isin(*CAUSAL_TYPES)
    etype = F.when(F.col("e.event_type") != "NonCausal", F.col("e.event_type"))
    own = F.when(F.col("ann_type").isin(*OVERLAPPING_TYPES), F.array("ann_type")).otherwise(F.array().cast("array<string>"))
    types = F.array_sort(F.array_union(own, F.coalesce("extra", F.array().cast("array<string>"))))
    name = F.coalesce("e.event_id", "trigger_id")
    columns = lambda kind, typ, deg, over, ident, attached: [
        "doc_id", "sent_id", ident.alias("inst_id"), F.lit(kind).alias("kind"), "connective", "cause", "effect", "means", typ.cast("string").alias("causal_type"),
        deg.cast("string").alias("degree"), over.alias("overlap_types"), attached.cast("string").alias("attached_inst_id"),
    ]
    none = F.lit(None)
    out = all_.filter(causal).select(*columns("causal", F.coalesce(etype, F.col("ann_type")), F.col("degree"), F.array().cast("array<string>"), name, none))
    if ignore_overlapping:
        return out
    clones = all_.filter(causal & (F.size("extra") > 0)).select(*columns("overlapping", none, none, F.col("extra"), F.concat(name, F.lit("+")), name))
    other = all_.filter(~causal).select(*columns("overlapping", none, none, types, name, none))
    return out.unionByName(clones).unionByName(other)


# --- writing


def fragments(tokens: str | Column, text: str | Column, indices: str | Column) -> Column:
    """Character fragments of a token set: runs of neighbours, cut where indices skip or a line ends between tokens.

    Tokens that don't stand in the text are left out. A run begins at a token whose predecessor in the set is not the one before it.
    """
    text = F.col(text) if isinstance(text, str) else text
    own = F.array_sort(F.filter(tokens, lambda t: F.array_contains(indices, t["idx"]) & t["start"].isNotNull()))

    def begins(t, k):
        before = F.get(F.filter(own, lambda o: o["idx"] == t["idx"] - 1), F.lit(0))
        return before.isNull() | F.contains(F.substring(text, before["end"] + 1, t["start"] - before["end"]), F.lit("\n"))

    marked = F.transform(own, lambda t, k: t.withField("first", begins(t, k)))
    firsts = F.filter(marked, lambda t: t["first"])
    last = lambda f, k: F.array_max(F.transform(F.filter(marked, lambda t: (t["idx"] >= f["idx"]) & (F.get(firsts, k + 1).isNull() | (t["idx"] < F.get(firsts, k + 1)["idx"]))), lambda t: t["end"]))
    return F.transform(firsts, lambda f, k: F.struct(f["start"].alias("start"), last(f, k).alias("end")))


_PARTS = ("connective", "cause", "effect", "means")


def standoff_lines(rows: DataFrame, sentences: DataFrame | None, texts: DataFrame | None, first_char: Column | int = 0) -> DataFrame:
    """(doc_id, line_no, line) of instances (INSTANCE) over sentences and (doc_id, text).

    Spans used twice are written once. Events and attributes are numbered per document in the order of their connectives; an
    instance without a type is written as UNKNOWN. first_char is taken off all offsets (S18). Without sentences and texts, rows carry the tokens (at least
    their own), text and start of their sentence.
    """
    # the parts of an instance are rows, so that fragments are one expression; what is numbered from them is cut from that plan
    named = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("indices")) for k, c in enumerate(_PARTS)])
    if sentences is None:
        moved = lambda by: lambda x: x.withField("start", x["start"] + by).withField("end", x["end"] + by)
        placed = rows.withColumn("tokens", F.transform("tokens", moved(-F.col("start")))).withColumnRenamed("start", "_at")
    else:
        placed = rows.join(sentences.select("doc_id", "sent_id", "tokens"), ["doc_id", "sent_id"]).join(texts.select("doc_id", "text"), "doc_id").withColumn("_at", F.lit(0))
    parts = placed.select("_at", "doc_id", "sent_id", "inst_id", "kind", "causal_type", "degree", "overlap_types", "text", "tokens", F.inline(F.filter(named, lambda p: F.size(p["indices"]) > 0)))
    parts = parts.withColumn("frags", fragments("tokens", "text", "indices")).filter(F.size("frags") > 0)
    said = F.array_join(F.transform("frags", lambda f: F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"])), " ")
    parts = parts.withColumn("said", said).withColumn("frags", F.transform("frags", lambda f: F.struct((f["start"] + F.col("_at")).alias("start"), (f["end"] + F.col("_at")).alias("end"))))
    per = parts.groupBy("doc_id", "sent_id", "inst_id", "kind", "causal_type", "degree", "overlap_types").agg(F.collect_list(F.struct("k", "frags", "said")).alias("parts"))
    order = F.transform(F.filter("parts", lambda p: p["k"] == 0), lambda p: p["frags"])
    w = Window.partitionBy("doc_id").orderBy(F.get(order, F.lit(0)), "sent_id", "inst_id")
    label = F.when(F.col("kind") == "causal", F.coalesce("causal_type", F.lit("UNKNOWN"))).otherwise("NonCausal")
    r = staged(per.withColumn("n", F.row_number().over(w)).withColumn("label", label))
    uses = r.select("doc_id", "n", "label", F.inline("parts"))
    # arguments are shared, connectives belong to their instance
    uses = uses.select("doc_id", "n", "k", "frags", "said", F.when(F.col("k") == 0, F.col("label")).otherwise("Argument").alias("type"), F.when(F.col("k") == 0, F.col("n")).otherwise(0).alias("own"))
    ids = uses.groupBy("doc_id", "type", "frags", "own").agg(F.min("n").alias("first"), F.first("said").alias("said"), F.collect_list(F.struct("n", "k")).alias("used"))
    ids = staged(ids.withColumn("tid", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "own", "frags", "type"))))
    shift = F.lit(first_char) if isinstance(first_char, int) else first_char
    where = F.array_join(F.transform("frags", lambda f: F.concat_ws(" ", (f["start"] - shift).cast("string"), (f["end"] - shift).cast("string"))), ";")
    t_lines = ids.select("doc_id", F.lit(0).alias("k"), F.col("tid").alias("m"), F.lit(0).alias("p"), F.concat(F.lit("T"), F.col("tid"), F.lit("\t"), F.col("type"), F.lit(" "), where, F.lit("\t"), "said").alias("line"))
    given = ids.select("doc_id", "tid", F.inline("used")).groupBy("doc_id", "n").agg(*[F.max(F.when(F.col("k") == k, F.col("tid"))).alias(c) for k, c in enumerate(_PARTS)])
    role = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" {c.capitalize()}:T"), F.col(c))).otherwise("")
    e = given.join(r.select("doc_id", "n", "label", "degree", "overlap_types"), ["doc_id", "n"])
    e_lines = e.select("doc_id", F.lit(1).alias("k"), F.col("n").alias("m"), F.lit(0).alias("p"), F.concat(F.lit("E"), F.col("n"), F.lit("\t"), F.col("label"), F.lit(":T"), F.col("connective"), *[role(c) for c in _PARTS[1:]]).alias("line"))
    no = F.array().cast("array<string>")
    attr = F.concat(F.when(F.col("degree").isNotNull(), F.array(F.concat(F.lit("Degree E"), F.col("n"), F.lit(" "), F.col("degree")))).otherwise(no), F.transform(F.coalesce("overlap_types", no), lambda t: F.concat(F.regexp_replace(t, "_", "-"), F.lit(" E"), F.col("n"))))
    a = e.select("doc_id", F.lit(2).alias("k"), F.col("n").alias("m"), F.posexplode(attr).alias("p", "line"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "m", "p"))
    a_lines = a.select("doc_id", "k", "m", "p", F.concat(F.lit("A"), nth, F.lit("\t"), F.col("line")).alias("line"))
    lines = t_lines.unionByName(e_lines).unionByName(a_lines)
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "m", "p")) - 1).alias("line_no"), "line")


def trimmed(sentences: DataFrame, first: int, last: int) -> DataFrame:
    """Sentences first to last of each document, offsets rebased to the first one's start."""
    s = sentences.filter(F.col("sent_id").between(first, last))
    base = F.min("start").over(Window.partitionBy("doc_id"))
    s = s.withColumn("_b", base)
    moved = F.transform("tokens", lambda t: t.withField("start", t["start"] - F.col("_b")).withField("end", t["end"] - F.col("_b")))
    return s.select("doc_id", (F.col("sent_id") - first).alias("sent_id"), (F.col("start") - F.col("_b")).alias("start"), (F.col("end") - F.col("_b")).alias("end"), "text", moved.alias("tokens"), "edges", "nodes")


def corrected_lines(lines: DataFrame, originals: DataFrame) -> DataFrame:
    """Annotation lines (doc_id, line_no, line) whose span offsets allow for texts in which double quotes became two characters.

    originals: (doc_id, text) before the quotes were rewritten. Lines of other kinds, of texts that aren't there, and malformed ones stay as they are.
    """
    f = F.split("line", "\t")
    parts = F.split(F.get(f, F.lit(1)), "(?<=[ ;])|(?=[ ;])")
    moved = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), shift_by_quotes(F.col("text"), p.cast("int")).cast("string")).otherwise(p)), "")
    span = F.col("line").rlike(r"^T[^\t]*\t[^ \t]+ [0-9]+ [0-9]+(;[0-9]+ [0-9]+)*\t") & F.col("text").isNotNull()
    new = F.concat_ws("\t", F.get(f, F.lit(0)), moved, F.array_join(F.slice(f, 3, 1 << 30), "\t"))
    return lines.join(originals.select("doc_id", "text"), "doc_id", "left").select("doc_id", "line_no", F.when(span, new).otherwise(F.col("line")).alias("line"))


def correct_offsets(spark: SparkSession, originals: str, annotations: str, target: str) -> None:
    """The annotations of one folder with corrected offsets, written under ``target`` as text, a folder for each base name; the sources stay as they are."""
    base = F.regexp_extract("doc_id", "([^/]*)$", 1)
    texts = files(spark, originals, "*.txt").select(base.alias("doc_id"), F.col("content").alias("text"))
    fixed = corrected_lines(annotation_lines(spark, annotations).withColumn("doc_id", base), texts)
    fixed.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").select("doc_id", F.col("line").alias("value")).write.partitionBy("doc_id").text(target)
