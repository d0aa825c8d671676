"""Output blocks and the commands they answer, and contradictions between the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import images

DIGEST = r"sha256:[a-f0-9]{64}"


def linked(blocks: DataFrame, item: Sequence[str], order: str = "ordinal", key: str = "block_id") -> DataFrame:
    """Blocks with responds_to, output_hops and unpaired.

    An output block answers the nearest block before it in its item that is no output, if that is a shell block; hops
    are the output blocks between. The rows of an item are few, so a window a item suffices.
    """
    by = Window.partitionBy(*item).orderBy(order, key)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    is_output = F.col("kind") == "output"
    df = blocks.withColumn("place_", F.row_number().over(by))
    anchor = F.last(F.when(~is_output, F.struct(F.col("place_").alias("place"), F.col(key).alias("key"), F.col("kind").alias("kind"))), ignorenulls=True).over(before)
    df = df.withColumn("anchor_", F.when(is_output, anchor))
    fits = F.col("anchor_.kind") == "shell"
    df = df.withColumn("responds_to", F.when(fits, F.col("anchor_.key"))).withColumn("output_hops", F.when(fits, F.col("place_") - F.col("anchor_.place") - 1))
    return df.withColumn("unpaired", is_output & F.col("responds_to").isNull()).drop("anchor_", "place_")


def expected_output(paired: DataFrame, order: str = "ordinal", key: str = "block_id") -> DataFrame:
    """(responds_to, expected): the output blocks of each command in order."""
    rows = paired.where("responds_to is not null").groupBy("responds_to").agg(F.array_sort(F.collect_list(F.struct(order, F.col(key).alias("key")))).alias("rows_"))
    return rows.select("responds_to", F.transform("rows_", lambda r: r["key"]).alias("expected"))


def digest_mismatch(command: Column, output: Column) -> Column:
    a, b = (F.array_distinct(F.regexp_extract_all(c, F.lit(f"({DIGEST})"), 1)) for c in (command, output))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def image_mismatch(command_refs: Column, output_refs: Column) -> Column:
    a, b = (F.array_distinct(F.transform(c, images.repository)) for c in (command_refs, output_refs))
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def tag_mismatch(command_refs: Column, output_refs: Column) -> Column:
    """struct<repo, tag, shown> of the first tagged image of the command that the output shows with another tag."""

    def other(ref: Column) -> Column:
        repo, tag = images.repository(ref), images.tag(ref)
        shown = F.filter(output_refs, lambda o: (images.repository(o) == repo) & (F.coalesce(images.tag(o), F.lit("")) != "") & (images.tag(o) != tag))
        return F.when(tag.isNotNull() & (F.size(shown) > 0), F.struct(repo.alias("repo"), tag.alias("tag"), images.tag(F.element_at(shown, 1)).alias("shown")))

    return F.try_element_at(F.array_compact(F.transform(command_refs, other)), F.lit(1))


def warnings(paired: DataFrame, key: str = "block_id") -> DataFrame:
    """(block_id, rule) of commands that contradict their output; needs code and image_refs of all blocks."""
    outputs = paired.where("responds_to is not null").groupBy(F.col("responds_to").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "code", "image_refs"))).alias("out_")
    )
    df = paired.select(key, "code", "image_refs").join(outputs, key)
    output = F.array_join(F.transform("out_", lambda r: r["code"]), "\n")
    refs = F.flatten(F.transform("out_", lambda r: r["image_refs"]))
    rules = F.array_compact(
        F.array(
            F.when(digest_mismatch(F.col("code"), output), "digest-mismatch"),
            F.when(image_mismatch(F.col("image_refs"), refs), "image-mismatch"),
            F.when(tag_mismatch(F.col("image_refs"), refs).isNotNull(), "tag-mismatch"),
        )
    )
    return df.select(key, F.explode(rules).alias("rule"))
