"""Building tar datasets from tar datasets.

Rows are paired and numbered on an index of the shards (names, places, captions);
the image bytes are fetched by the task that writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framekiln.functions import fields
from framekiln.operators import pairing, sharding
from framekiln.session import written
from framekiln.sources import tar, tar_index


def _has(spark: SparkSession, paths, members: Sequence[str], index_path: str | None = None) -> DataFrame:
    """The samples that have these members, without bodies.

    They are written once, as numbering reads them more than once and a scan opens every
    shard. With an ``index_path`` only shards that are not in that index yet are opened.
    """
    if index_path:
        found = tar_index.indexed_samples(spark, paths, index_path, sizes=False)
        for member in members:
            found = found.filter(F.array_contains("members", member))
    else:
        found = tar.tar_scan(spark, paths, fields=[], required=list(members))
    return written(found.select("shard", "shard_idx", "pos", "key", "bytes"), "index")


def reshard(
    spark: SparkSession,
    paths: str | list[str],
    out: str,
    shard_size: int,
    members: Sequence[str] = ("jpg", "txt"),
    drop_tail: bool = False,
    index_path: str | None = None,
) -> None:
    """Deal the samples of all shards into new shards of ``shard_size``.

    Samples that lack any of ``members`` are left out; keys are renumbered per shard. ``index_path`` is where a member index
    of the shards is, or shall be.
    """
    index = _has(spark, paths, members, index_path)
    dealt = sharding.shard_numbering(index, shard_size, drop_tail=drop_tail, block_rows=tar.BLOCK_UNITS)
    fetched = tar.with_members(tar.by_shard(dealt, tar.fetch_tasks(index)), list(members))
    bodies = fetched.withColumns({m: fields.field(F.col("fields"), m) for m in members})
    tar.write_shards(bodies, out, list(members))


def build_captioned(
    spark: SparkSession,
    image_paths: str | list[str],
    caption_paths: str | list[str],
    out: str,
    shard_size: int,
    image: str = "jpg",
    caption_field: str = "sharecap_caption",
) -> None:
    """Images with the captions of a second dataset, as new shards ``image`` + ``txt``.

    The i-th caption shard in name order belongs to the i-th image shard; its JSON
    members hold ``key`` and the caption. The image's own key is kept.
    """
    images = _has(spark, image_paths, [image])
    json = tar.tar_scan(spark, caption_paths, fields=["json"]).select(
        "shard_idx", F.col("pos").alias("caption_pos"), fields.text_field(F.col("fields"), "json").alias("json")
    )
    captions = pairing.json_fields(json, F.col("json"), {"key": "string", caption_field: "string"})
    captions = captions.filter(F.col(caption_field).isNotNull()).withColumnRenamed(caption_field, "caption")
    paired = written(pairing.caption_join(images, captions, position="caption_pos"), "paired")
    dealt = sharding.shard_numbering(paired, shard_size, block_rows=tar.BLOCK_UNITS)
    fetched = tar.with_members(tar.by_shard(dealt, tar.fetch_tasks(paired)), [image])
    bodies = fetched.withColumns({image: fields.field(F.col("fields"), image), "txt": F.col("caption")})
    tar.write_shards(bodies, out, [image, "txt"], key="key")
