"""Personal data: exact patterns, and terms that give a protected entity away (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireworks.functions import text as T
from quireworks.llm.common import discard, join_sized, stage

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the patterns.  A match can only start where a run of its characters starts or the last match ended, and
#: runs are taken whole, which finds the same leftmost matches without trying every place of a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]++"
SUPPORT = 2
GENERALISE, REMOVE = 0.7, 0.9
#: Distinct terms up to which the corpus count filters words before it shuffles them
FEW = 1_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checker(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _tagger(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _located(gaps: Column, hits: Column) -> Column:
    """Matches with their places: the lengths of the pieces between them, added up."""
    spans = F.zip_with(T.placed(gaps, hits), hits, lambda r, h: F.struct(r["start"].alias("start"), r["end"].alias("end"), h.alias("value")))
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and, per kind, the array of its valid spans (start, end, value), in code points.

    One row per given row, null ids and repeated rows too; a null text is an empty one, without spans.
    """
    hint = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ip": F.col("text").contains("."), "card": F.lit(True)}
    # one search per kind decides whether the costlier cutting is needed
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    out = out.withColumns({f"h_{k}": F.when(hint[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"g_{k}": F.when(F.size(f"h_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    return out.select(
        "doc_id", "text", *[F.filter(_located(F.col(f"g_{k}"), F.col(f"h_{k}")), _checker(k)).alias(k) for k in KINDS]
    )


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


class Spans:
    """All personal data of a table: .documents has a row per document, .terms a row per term span of a text.

    Equal texts have equal spans, so terms are counted and marked once per distinct text (text_hash), with the number of
    its documents as weight.  Entities that occur in the same texts have the same co-occurrences and are counted as one
    group, so a long list of addresses is not multiplied with its text's words.
    """

    def __init__(self, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE):
        found = base_spans(docs)
        tagged = F.concat(*[F.transform(F.col(k), _tagger(k)) for k in KINDS])
        self.documents, _ = stage(
            found.select(
                F.monotonically_increasing_id().alias("row"), "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                tagged.alias("base"), F.when(F.size(tagged) > 0, F.col("text")).alias("text"),
                F.when(F.size(tagged) > 0, F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.reverse("text"))))).alias("text_hash"),
            ),
            "pii-base",
        )
        self.terms = self._revealing(docs, support, generalise, remove)

    def _groups(self, support: int) -> tuple[DataFrame, DataFrame]:
        """Groups of entities that occur in the same texts, `support` of them at least: (group, n_entity), and their texts
        (text_hash, group, copies)."""
        some = self.documents.where(F.size("base") > 0)
        texts, _ = stage(some.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("row").alias("row")), "pii-texts")
        once = some.join(texts.select("row", "copies"), "row")
        mentions, mentions_at = stage(
            once.select("text_hash", "copies", F.explode(F.array_distinct(F.transform("base", lambda e: _entity(e["kind"], e["value"])))).alias("entity")), "pii-mentions"
        )
        entities = mentions.groupBy("entity").agg(
            F.count("*").alias("n_texts"), F.sum("copies").alias("n_entity"), F.bit_xor(F.xxhash64("text_hash")).alias("h1"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("h2")
        ).where(F.col("n_texts") >= support)
        entities, entities_at = stage(entities.withColumn("group", F.xxhash64("n_texts", "h1", "h2")), "pii-entities")
        groups, _ = stage(entities.groupBy("group").agg(F.min("entity").alias("entity"), F.first("n_entity").alias("n_entity")), "pii-groups")
        members, _ = stage(join_sized(mentions, groups.select("entity", "group"), "entity", "inner").select("text_hash", "group", "copies"), "pii-members")
        discard(self.documents.sparkSession, mentions_at, entities_at)
        return groups, members

    def _located_terms(self, members: DataFrame) -> DataFrame:
        """text_hash, term, start, end of every term outside the base spans, for texts with a group of entities."""
        texts = members.select("text_hash").distinct()
        some = self.documents.where(F.size("base") > 0).groupBy("text_hash").agg(F.min("row").alias("row"))
        chosen = join_sized(some, texts, "text_hash", "left_semi").select("row")
        rows = join_sized(self.documents.where(F.size("base") > 0), chosen, "row", "left_semi")
        pieces = rows.select(
            "text_hash", F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
            F.posexplode(F.arrays_zip(F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("hit"))).alias("n", "p"),
        )
        # places are running sums of the pieces' lengths: one text's pieces to a window
        before = F.sum(F.length("p.gap") + F.coalesce(F.length("p.hit"), F.lit(0))).over(Window.partitionBy("text_hash").orderBy("n"))
        placed = pieces.select("text_hash", "base", F.col("p.hit").alias("hit"), before.alias("end")).where("hit is not null")
        start, end = (F.col("end") - F.length("hit")).cast("int"), F.col("end").cast("int")
        clear = ~F.exists("base", lambda b: (b["start"] < end) & (start < b["end"]))
        return placed.where(clear).select("text_hash", F.lower("hit").alias("term"), start.alias("start"), end.alias("end"))

    def _revealing(self, docs: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
        groups, members = self._groups(support)
        located, _ = stage(self._located_terms(members), "pii-located")
        present = located.groupBy("text_hash").agg(F.collect_set("term").alias("terms"))
        pairs = (
            members.join(present, "text_hash").select("group", "copies", F.explode("terms").alias("term"))
            .groupBy("group", "term").agg(F.count("*").alias("n_texts"), F.sum("copies").alias("n_both"))
            .where(F.col("n_texts") >= support).select("group", "term", "n_both")
        )
        pairs, _ = stage(pairs, "pii-pairs")
        wanted = pairs.select("term").distinct()
        total = self.documents.count()
        words = docs.select(F.explode(F.array_distinct(_terms(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("term"))
        if wanted.limit(FEW + 1).count() <= FEW:
            counts = join_sized(words, wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
        else:  # count before the shuffle
            counts = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")
        both, n_e, n_t, n = F.col("n_both"), F.col("n_entity"), F.col("n_term"), F.lit(float(max(total, 1)))
        information = F.log2(n / n_e)
        mutual = F.log2(both * n / (n_e * n_t))
        scored = (
            pairs.join(groups, "group").join(counts, "term")
            .withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(0.0))
            .where(F.col("disclosure") >= generalise)
        )
        scored, _ = stage(scored.select("group", "term", "disclosure"), "pii-terms")
        worst = join_sized(members.select("text_hash", "group"), scored.select("group").distinct(), "group", "left_semi").join(scored, "group")
        worst = worst.groupBy("text_hash", "term").agg(F.max("disclosure").alias("disclosure"))
        return located.join(worst, ["text_hash", "term"]).select(
            "text_hash", "start", "end", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action")
        )

    def combined(self) -> DataFrame:
        """documents with `found`: the sorted array of term spans (start, end, action) of those that have any."""
        per = self.terms.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("found"))
        some = self.documents.where(F.size("base") > 0).join(per, "text_hash", "left")
        rest = self.documents.where(F.size("base") == 0).withColumn("found", F.lit(None).cast(per.schema["found"].dataType))
        return some.unionByName(rest)


def personal_data(docs: DataFrame, **limits: float) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive), comma-joined: first the pattern matches by kind and start,
    then, as kind `term`, words that give an entity of the same document away.  A term is a run of letters and digits of
    any length, anywhere in the document but in a base span.  It gives an entity away when at least `support` different
    texts hold both and its pointwise mutual information with the entity, over documents of the whole corpus, is at least
    `generalise` of the entity's own information; every place of it in a document that holds the entity is a span.

    A null text is an empty one and has no span.  Null ids and repeated rows give a row each; copies count as documents
    but their equal texts support a term only once.  Extra columns are ignored; an empty table gives an empty result.
    """
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    rows = Spans(docs, **limits).combined().withColumn("base_spans", F.transform("base", written))
    terms = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int,action:string>>")), lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base_spans", terms), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, **limits: float) -> DataFrame:
    """Documents that have personal data, as doc_id and text: entities as [KIND], terms as [TERM] or, where they disclose
    more than `remove`, left out.

    Base spans of different kinds may overlap; what is already replaced is not replaced again.  Texts without personal
    data, null and empty ones among them, give no row; null ids and repeated rows give a row each; extra columns are
    ignored and an empty table gives an empty result.
    """
    rows = Spans(docs, **limits).combined().where(F.size("base") > 0)
    mine = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform(F.coalesce("found", F.array().cast("array<struct<start:int,end:int,action:string>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("by")))
    ordered = F.array_sort(F.concat(mine, terms))

    rows = rows.withColumn("marks", ordered)
    # how far the spans before each one reach: what overlaps them is already replaced, only its rest goes
    reach = T.running_maxima(F.transform("marks", lambda s: s["end"].cast("long")))
    rows = rows.withColumn("reach", F.transform(F.array_prepend(reach, F.lit(0).cast("long")), lambda x: x.cast("int")))
    text = F.col("text")
    pieces = F.zip_with("marks", F.slice("reach", F.lit(1), F.size("marks")), lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(F.substring(text, at + 1, s["start"] - at), s["by"])))
    rest = F.substring(text, F.element_at("reach", -1) + 1, F.length(text))
    return rows.select("doc_id", F.concat(F.array_join(pieces, ""), rest).alias("text"))
