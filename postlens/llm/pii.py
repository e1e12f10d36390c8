"""Personal data by pattern, and sanitisation by information disclosed (operator 3), in native Spark functions only.

Base matches come from four patterns. Positions follow from splitting at the same pattern: a match
starts after all pieces and matches before it.

A term near a match (on its line, within REACH characters) may give the protected entity away even
when the match itself is masked. With counts over all documents, the entity has information
IC(e) = log2(N / df(e)), and a term t reveals PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) of it, where
df(e, t) counts documents with t near e. Terms seen with the entity in ``least`` documents or
more that reveal ``disclosure`` of IC(e) or more are spans of kind "term"; they are
generalised to their class of word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.files import written

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 80
# Anchors (\G or a run's start) and possessive repeats keep every pattern linear and its matches the same.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_TERM = r"(?<![\p{L}\p{N}_.@%+-])\p{L}{4,}(?![\p{L}\p{N}_@-])"


def _pieces(text: Column, pattern: str, kind: int, likely: Column) -> Column:
    """[(kind, nth, length of the piece before, match, end of the piece before, start of the piece after)], empty unless ``likely``."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.transform(F.arrays_zip(matches.alias("m"), F.slice(between, F.lit(1), F.size(matches)).alias("p"), F.slice(between, F.lit(2), F.size(matches)).alias("q")),
                         lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["p"]).alias("gap"), x["m"].alias("value"),
                                               F.right(x["p"], F.lit(REACH)).alias("before"), F.left(x["q"], F.lit(REACH)).alias("after")))
    return F.when(likely, zipped)


def _luhn(digits: Column) -> Column:
    wide = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        d = F.substring(wide, i, 1).cast("int")
        total = total + (d if (19 - i) % 2 == 0 else F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return total % 10 == 0


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, kind, start, end, value, before, after: one row per base match; a document without any has one row with a null kind.

    ``before`` and ``after`` are the REACH characters of the text on either side. ``rid`` numbers the rows of ``docs``. Only matches are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    t = F.col("t")
    kinds = [
        _pieces(t, EMAIL, 0, t.contains("@")),
        _pieces(t, IP, 1, t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        _pieces(t, CARD, 2, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        _pieces(t, PHONE, 3, t.contains("+") & t.rlike(r"\+[0-9]")),
    ]
    none = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,value:string,before:string,after:string>>)")
    found = rows.select("rid", "doc_id", F.explode_outer(F.concat(*[F.coalesce(k, none) for k in kinds])).alias("x")).select("rid", "doc_id", "x.*")
    found = found.repartition("rid")
    own = Window.partitionBy("rid", "kind")
    nth = own.orderBy("nth")
    size = F.length("value")
    found = found.withColumn("start", (F.sum(F.col("gap") + size).over(nth.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("long")).withColumn("end", F.col("start") + size)
    # the neighbouring match joins the piece between; such parts of all matches within REACH make up the text on either side
    reach = F.lit(REACH)
    found = found.withColumns({"before": F.right(F.concat(F.coalesce(F.lag("value").over(nth), F.lit("")), "before"), reach),
                               "after": F.left(F.concat("after", F.coalesce(F.lead("value").over(nth), F.lit(""))), reach)})
    found = found.withColumn("before", F.right(F.array_join(F.collect_list("before").over(own.orderBy("start").rangeBetween(-REACH, 0)), ""), reach))
    found = found.withColumn("after", F.left(F.array_join(F.collect_list("after").over(own.orderBy("end").rangeBetween(0, REACH)), ""), reach))
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    valid = (F.when(F.col("kind") == 1, F.col("value").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
             .when(F.col("kind") == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
             .when(F.col("kind") == 3, n.between(10, 15)).otherwise(True))
    shown = [F.when(valid, F.col(c)).alias(c) for c in ("kind", "start", "end", "value", "before", "after")]
    return found.select("rid", "doc_id", *shown)


def entity() -> Column:
    """A base match's entity: its kind and its value without case or separators."""
    value = F.when(F.col("kind").isin(2, 3), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.lower("value"))
    return F.concat_ws(":", F.col("kind").cast("string"), value)


def _near_terms(side: str, at: Column) -> Column:
    """Terms of a short context string with their places; ``at`` is where the string starts in the text."""
    own = F.col(side)
    own = F.regexp_extract(own, r"[^\n]*\z" if side == "before" else r"^[^\n]*", 0)
    skipped = F.length(side) - F.length(own) if side == "before" else F.lit(0)
    words, gaps = F.regexp_extract_all(own, F.lit(_TERM), F.lit(0)), F.split(own, _TERM, -1)
    return F.transform(words, lambda w, i: F.struct(
        F.lower(w).alias("term"),
        (at + skipped + F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda s, g: s + F.length(g))).cast("long").alias("start"),
        F.length(w).alias("size")))


def near_terms(found: DataFrame) -> DataFrame:
    """rid, entity, term, start, end: every term near every base match."""
    both = F.concat(_near_terms("before", F.col("start") - F.length("before")), _near_terms("after", F.col("end")))
    rows = found.where("kind is not null").select("rid", entity().alias("entity"), F.explode(both).alias("x"))
    return rows.select("rid", "entity", F.col("x.term").alias("term"), F.col("x.start").alias("start"), (F.col("x.start") + F.col("x.size")).alias("end"))


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df: number of documents with each term, over all documents and whole texts."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+"))
    return docs.select(F.explode(F.filter(words, lambda w: F.length(w) >= 4)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def disclosing_terms(docs: DataFrame, found: DataFrame, *, disclosure: float = 0.9, least: int = 2, text_col: str = "text") -> DataFrame:
    """entity, term, share: terms that reveal ``disclosure`` of an entity or more (share: PMI / IC)."""
    n = F.lit(float(docs.count()))
    of_entity = found.where("kind is not null").select("rid", entity().alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    pairs = near_terms(found).select("rid", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("df_et")).where(F.col("df_et") >= least)
    ic = F.log2(n / F.col("df_e"))
    pmi = F.log2(n * F.col("df_et") / (F.col("df_e") * F.greatest("df", "df_et")))
    scored = pairs.join(of_entity, "entity").join(term_documents(docs, text_col), "term").where(ic > 0)
    return scored.select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= disclosure)


def all_spans(docs: DataFrame, *, disclosure: float = 0.9, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, spans array<struct<start, kind, end, value>> sorted: one row per row of ``docs``.

    ``kind`` indexes KINDS. Null and empty texts have no spans; repeated rows are each for themselves; an
    empty table gives an empty table.
    """
    found = written(matches(docs, id_col, text_col), "pii")
    telling = disclosing_terms(docs, found, disclosure=disclosure, least=least, text_col=text_col).select("entity", "term")
    terms = near_terms(found).join(telling, ["entity", "term"]).select("rid", "start", "end", "term").distinct()
    span = lambda kind, value: F.struct(F.col("start"), kind.cast("int").alias("kind"), F.col("end"), value.alias("value"))
    base = found.select("rid", "doc_id", F.when(F.col("kind").isNotNull(), span(F.col("kind"), F.col("value"))).alias("s"))
    extra = terms.select("rid", F.lit(None).cast("long").alias("doc_id"), span(F.lit(4), F.col("term")).alias("s"))
    return base.union(extra).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("spans"))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts per kind, a hash of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return all_spans(docs, **options).select("doc_id", *number[:4], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), number[4])


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text: base matches masked as [EMAIL], [IP], [CARD], [PHONE]; disclosing terms generalised to [WORD].

    Of overlapping spans the one that starts first counts. Texts are joined to their spans by row, so they are shuffled once.
    """
    spans = all_spans(docs, id_col=id_col, text_col=text_col, **options).select("rid", "spans")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit("[WORD]"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    text = F.col("text")

    def step(acc, s):
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        moved = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece, F.element_at(masks, s["kind"] + 1))).alias("out"))
        return F.when(s["start"] >= acc["at"], moved).otherwise(acc)

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return rows.join(spans, "rid").select("doc_id", done.alias("text"))
