"""Drafts, their evidence and their audits: nested documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drafts(manifests: DataFrame) -> DataFrame:
    """(artifact_dir, day, pillar, label): manifests whose status marks a draft, with script and reel, whose time of generation can be read. A missing pillar
    is seasonal; a label is that of the season, its own, or the folder's name."""
    rows = manifests.dropDuplicates(["artifact_dir"]).withColumn("at", F.try_to_timestamp("generated_at", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    rows = rows.where(F.contains("status", F.lit("DRAFT")) & F.col("artifacts.script").isNotNull() & F.col("artifacts.reel").isNotNull() & F.col("at").isNotNull())
    pillar = F.coalesce("pillar", F.lit("seasonal"))
    label = F.when(pillar == "seasonal", F.col("season.label")).otherwise(F.col("label"))
    return rows.select("artifact_dir", F.to_date("at").alias("day"), pillar.alias("pillar"), F.coalesce(label, "artifact_dir").alias("label"))


def drafts_by_day(found: DataFrame) -> DataFrame:
    """(day, n, first): drafts of each day and the first by name."""
    return found.groupBy("day").agg(F.count("*").alias("n"), F.min("artifact_dir").alias("first"))


def evidence(manifests: DataFrame) -> DataFrame:
    """(artifact_dir, place, chunk_id, score): the retrieved chunks of each manifest in order."""
    rows = manifests.dropDuplicates(["artifact_dir"]).select("artifact_dir", F.posexplode("retrieved_chunks").alias("place", "c"))
    return rows.select("artifact_dir", "place", F.col("c.chunk_id").alias("chunk_id"), F.col("c.score").alias("score"))


def cited_texts(cited: DataFrame, chunks: DataFrame, missing: str = "(not found)") -> DataFrame:
    """(artifact_dir, place, chunk_id, text): each citation with its text, or `missing`. chunks: (chunk_id, text), one row an id."""
    return cited.join(chunks.select("chunk_id", "text", F.lit(1).alias("hit")), "chunk_id", "left").select("artifact_dir", "place", "chunk_id", F.when(F.col("hit").isNull(), missing).otherwise(F.col("text")).alias("text"))


def context_blocks(texts: DataFrame) -> DataFrame:
    """(artifact_dir, n, context): the texts of each manifest in order, each after its id, a blank line between."""
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col("chunk_id"), F.lit("]")), F.coalesce("text", F.lit("")))
    items = F.array_sort(F.collect_list(F.struct("place", block.alias("b"))))
    return texts.groupBy("artifact_dir").agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x.b), "\n\n").alias("context"))


def unknown_citations(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(artifact_dir, chunk_id): cited ids that no chunk has."""
    return cited.select("artifact_dir", "chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("artifact_dir", "chunk_id")


def scene_verdicts(reports: DataFrame) -> DataFrame:
    """(artifact_dir, scene_index, grounded, compliance_ok, n_issues)."""
    rows = reports.dropDuplicates(["artifact_dir"]).select("artifact_dir", F.explode("scenes").alias("s"))
    return rows.select("artifact_dir", "s.scene_index", "s.grounded", "s.compliance_ok", F.size(F.coalesce("s.issues", F.array().cast("array<string>"))).alias("n_issues"))


def audit_rollup(reports: DataFrame) -> DataFrame:
    """(artifact_dir, stated, computed, n_scenes): a report's stated verdict beside that of its scenes: all grounded and compliant. No scene fails nothing."""
    sound = F.forall(F.coalesce("scenes", F.lit(None)), lambda s: F.coalesce(s.grounded, F.lit(False)) & F.coalesce(s.compliance_ok, F.lit(False)))
    rows = reports.dropDuplicates(["artifact_dir"])
    return rows.select("artifact_dir", F.col("overall_pass").alias("stated"), F.coalesce(sound, F.lit(True)).alias("computed"), F.coalesce(F.size("scenes"), F.lit(0)).alias("n_scenes"))


def structure_failures(manifests: DataFrame) -> DataFrame:
    """(artifact_dir, passed, failures): what is wrong with a manifest's parts, in a fixed order."""
    clips, audio = F.coalesce(F.size("artifacts.clips"), F.lit(0)), F.coalesce(F.size("artifacts.audio"), F.lit(0))
    checks: list[tuple[Column, str]] = [
        (F.coalesce(F.trim("query"), F.lit("")) == "", "no query"),
        (F.coalesce(F.size("retrieved_chunks"), F.lit(0)) <= 0, "no evidence"),
        ((F.coalesce("n_scenes", F.lit(0)) > 0) & (clips != F.col("n_scenes")), "clips differ from scenes"),
        (clips != audio, "clips and audio differ"),
        (F.col("artifacts.reel").isNull(), "no reel"),
    ]
    failures = F.filter(F.array(*[F.when(c, m) for c, m in checks]), lambda x: x.isNotNull())
    return manifests.dropDuplicates(["artifact_dir"]).select("artifact_dir", failures.alias("f")).select("artifact_dir", (F.size("f") == 0).alias("passed"), F.array_join("f", "; ").alias("failures"))


def clip_timeline(manifests: DataFrame, seconds: float = 8.0, first: float = 6.0, overlap: float = 0.5) -> DataFrame:
    """(artifact_dir, place, clip, starts): clips laid end to end, each overlapping the one before it."""
    rows = manifests.dropDuplicates(["artifact_dir"]).select("artifact_dir", F.posexplode("artifacts.clips").alias("place", "clip"))
    length = F.when(F.col("place") == 0, first).otherwise(seconds) - overlap
    before = F.sum(length).over(Window.partitionBy("artifact_dir").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("artifact_dir", "place", "clip", F.coalesce(before, F.lit(0.0)).alias("starts"))


def reel_lengths(manifests: DataFrame, seconds: float = 8.0, first: float = 6.0, overlap: float = 0.5) -> DataFrame:
    """(artifact_dir, n, length): clips of each draft and their length end to end with overlaps; no clips last 0 seconds."""
    n = F.coalesce(F.size("artifacts.clips"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    rows = manifests.dropDuplicates(["artifact_dir"]).select("artifact_dir", n.alias("n"))
    return rows.withColumn("length", F.when(F.col("n") == 0, 0.0).otherwise(first + (F.col("n") - 1) * (seconds - overlap)))


def voice(name: F.Column, voices: list[str]) -> F.Column:
    """One of some voices, always the same for a name: by the first eight digits of its MD5."""
    return F.element_at(F.array(*map(F.lit, voices)), (F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint"), F.lit(len(voices))) + 1).cast("int"))


def paired_media(manifests: DataFrame) -> DataFrame:
    """(artifact_dir, place, clip, audio): clips and audio by place, of manifests that have as many of both."""
    rows = manifests.dropDuplicates(["artifact_dir"]).where(F.size("artifacts.clips") == F.size("artifacts.audio"))
    pairs = F.arrays_zip(F.col("artifacts.clips").alias("clip"), F.col("artifacts.audio").alias("audio"))
    return rows.select("artifact_dir", F.posexplode(pairs).alias("place", "p")).select("artifact_dir", "place", F.col("p").getField("clip").alias("clip"), F.col("p").getField("audio").alias("audio"))


# What stands for texts that are not there.
NOT_FOUND, NONE_CITED, BY_DESIGN = "(not found)", "(no ids cited)", "(none by design)"


def audit_blocks(scenes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(artifact_dir, scene_index, exempt, block): what an auditor reads of every scene: its number, what is said and the texts that it cites, in order. Scene
    0 is the hook, which need not be grounded (exempt). scenes: (artifact_dir, scene_index, said, ids). chunks: (chunk_id, text), one row an id."""
    cited = scenes.select("artifact_dir", "scene_index", F.posexplode("ids").alias("place", "chunk_id"))
    texts = cited.join(chunks.select("chunk_id", "text", F.lit(1).alias("hit")), "chunk_id", "left")
    line = F.concat(F.lit("  ["), F.col("chunk_id"), F.lit("]: "), F.when(F.col("hit").isNull(), NOT_FOUND).otherwise(F.coalesce("text", F.lit(""))))
    items = F.array_sort(F.collect_list(F.struct("place", line.alias("t"))))
    texts = texts.groupBy("artifact_dir", "scene_index").agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("texts"))
    hook = F.col("scene_index") == 0
    body = F.when(hook, f"  {BY_DESIGN}").otherwise(F.coalesce("texts", F.lit(f"  {NONE_CITED}")))
    rows = scenes.join(texts, ["artifact_dir", "scene_index"], "left")
    return rows.select("artifact_dir", "scene_index", hook.alias("exempt"), F.concat_ws("\n", F.concat(F.lit("SCENE "), F.col("scene_index").cast("string")), "said", body).alias("block"))


def slugs(manifests: DataFrame) -> DataFrame:
    """(artifact_dir, slug): what each draft is about and the UTC time of its generation, hyphens between."""
    rows = drafts(manifests).join(manifests.dropDuplicates(["artifact_dir"]).drop("pillar", "label"), "artifact_dir")
    at = F.date_format(F.try_to_timestamp("generated_at", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), "yyyyMMdd-HHmmss")
    about = F.concat_ws("-", "pillar", F.nullif(F.array_join("season.aggravated_dosha", "-"), F.lit("")), "dosha", "topic", "service")
    return rows.select("artifact_dir", F.concat_ws("-", about, at).alias("slug"))
