"""Operations on stored tables: upsert, lookups, listings, deletion, limits and permalinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.checks import latest
from veritab.runtime import divided

LIMITS = {"document": 5, "query": 50}  # fixed values: actions a user may take


def upsert(stored: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows but for those whose key is written again, and the last written row of each key (by ``write_seq``)."""
    new = latest(written, keys, "write_seq")
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def all_facts(**tables: DataFrame) -> DataFrame:
    """Facts of all kinds under each other: kind, doc_id, page, fact_ord, id."""
    out = None
    for kind, table in tables.items():
        rows = table.select(F.lit(kind).alias("kind"), "doc_id", "page", "fact_ord", "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def object_counts(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """Documents with their number of distinct facts of each kind. Each side is counted before it is joined, so nothing multiplies."""
    for kind, table in tables.items():
        documents = documents.join(table.select("doc_id", "id").distinct().groupBy("doc_id").agg(F.count("id").alias(f"n_{kind}")), "doc_id", "left").na.fill(0, [f"n_{kind}"])
    return documents


def delete_documents(table: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return table.join(doc_ids, "doc_id", "left_anti")


def link(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows (such as project_id, doc_id, added_at), ignoring those that are there."""
    return stored.unionByName(new.join(stored, keys, "left_anti").dropDuplicates(keys))


def unlink(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Takes rows away; what is not there is ignored. With ``keys`` project_id alone, all links of a project that is deleted."""
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def project_counts(projects: DataFrame, links: DataFrame, uid: str | None = None) -> DataFrame:
    """Projects (of one owner, or all) with their number of documents; links are counted before they are joined."""
    rows = projects if uid is None else projects.where(F.col("owner_uid") == uid)
    counts = links.groupBy("project_id").agg(F.count("doc_id").alias("doc_count"))
    return rows.join(counts, "project_id", "left").na.fill(0, ["doc_count"])


def project_documents(links: DataFrame, documents: DataFrame, project_id: str | None = None) -> DataFrame:
    """The documents of a project, or of all projects, with the time they were added; links to documents that are gone are left out."""
    rows = links if project_id is None else links.where(F.col("project_id") == project_id)
    return rows.join(documents, "doc_id")


def owned(rows: DataFrame, uid: str, owner: str = "owner_uid") -> DataFrame:
    return rows.where(F.col(owner).isNull() | (F.col(owner) == uid))


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """The newest rows; equal times by key."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


class Pages:
    """Rows in order, in ranges: any page is read from the ranges that hold it, without a sort of all rows.

    ``order``: columns that name a row and put it in its place. Rows are dealt out by ranges and
    written as a table divided by them, with how many each has and the first of its keys beside it.
    """

    def __init__(self, rows: DataFrame, order: list[str]) -> None:
        self.order = order
        key = F.struct(*order)
        dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
        self.table = divided(dealt, "_range")
        counts = self.table.groupBy("_range").agg(F.count("*").alias("n"), F.min(key).alias("first"))
        self.ranges = sorted(counts.collect(), key=lambda r: r._range)  # a row for each range

    def _of(self, ranges: list[int]) -> DataFrame:
        return self.table.where(F.col("_range").isin(ranges) if ranges else F.lit(False)).drop("_range")

    def page(self, most: int, skip: int = 0) -> DataFrame:
        """``most`` rows after the first ``skip``."""
        before, at, held = 0, 0, []
        for r in self.ranges:
            if before + r.n > skip and before < skip + most:
                held.append(r._range)
                at = at if len(held) > 1 else before
            before += r.n
        return self._of(held).orderBy(*self.order).offset(max(0, skip - at)).limit(most)

    def after(self, key: tuple, most: int) -> DataFrame:
        """The ``most`` rows behind the row of this key."""
        started = [i for i, r in enumerate(self.ranges) if tuple(r.first) <= key]
        begin, n, held = started[-1] if started else 0, 0, []
        for r in self.ranges[begin:]:
            held.append(r._range)
            n += r.n if len(held) > 1 else 0  # of the first range any number may be behind the key
            if n >= most:
                break
        place = F.struct(*[F.lit(k).cast(self.table.schema[c].dataType).alias(c) for c, k in zip(self.order, key, strict=True)])
        later = F.struct(*self.order) > place
        return self._of(held).where(later).orderBy(*self.order).limit(most)


def page(rows: DataFrame, order: list[str], most: int, skip: int = 0) -> DataFrame:
    """One page of rows; for several pages keep a ``Pages``."""
    return Pages(rows, order).page(most, skip)


def append_audit(events: DataFrame, path: str) -> None:
    """Appends events (doc_id, action, actor, details_json) to the log at ``path``, with the time and an id. Nothing that is there is read or changed."""
    stamped = events.select(F.expr("uuid()").alias("id"), "doc_id", "action", "actor", "details_json", F.current_timestamp().alias("created_at"))
    stamped.write.mode("append").parquet(path)


def usage_summary(usage: DataFrame) -> DataFrame:
    """Per user and limited action: used, remaining, allowed. An action without a limit is always allowed."""
    top = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])[F.col("action")]
    used = usage.groupBy("user_id", "action").agg(F.count("*").alias("used"))
    return used.withColumns({"remaining": F.greatest(F.lit(0), top - F.col("used")), "allowed": F.coalesce(F.col("used") < top, F.lit(True))})


def permalink(doc_id: Column, question: Column, answer: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc_id, question, answer), 256), 1, 12)


def valid_doc_id(doc_id: Column) -> Column:
    """A version-4 UUID, or letters, digits, _ and -."""
    return F.coalesce(doc_id.rlike(r"^[a-zA-Z0-9_-]+\n?$"), F.lit(False))


def share(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Shared answers with ``new`` ones written in: of an id that is there already, document, question and page stay, and the rest is replaced."""
    kept = ["doc_id", "question", "source_page"]
    old = stored.select("question_id", *[F.col(c).alias(f"_{c}") for c in kept], F.lit(True).alias("_old"))
    fresh = new.join(old, "question_id", "left")
    fresh = fresh.select(*[F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in new.columns])
    return stored.join(new.select("question_id"), "question_id", "left_anti").unionByName(fresh)


def preview(shared: DataFrame) -> DataFrame:
    """The beginnings of question and answer, for a card."""
    return shared.withColumns({"question": F.substring("question", 1, 100), "answer": F.substring("answer", 1, 200)})


def migrate(spark: SparkSession, tables: list[str], source: str, target: str) -> DataFrame:
    """Copies tables from one folder to another; (table, n) as written."""
    out = None
    for name in tables:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
        one = spark.read.parquet(f"{target}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def populate(corpus: DataFrame, entries: DataFrame) -> DataFrame:
    """The corpus with entries (content_hash, mpn, chip_name, datasheet_url, canonical_data, created_at) written in; the newest of a hash stays."""
    return upsert(corpus, entries.withColumn("write_seq", F.col("created_at")), ["content_hash"]).drop("write_seq")
