"""The findings that can be made: a small fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids of the findings; categories and severities are ours where nothing prescribes them.
FINDINGS = {
    "dead-link": ("defect", "error"), "dead-image": ("defect", "error"), "missing-fragment": ("defect", "error"), "moved-link": ("stale", "error"),
    "moved-link-review": ("stale", "warning"), "temporary-redirect": ("stale", "warning"), "unreachable-link": ("stale", "warning"),
    "drifted-copy-code": ("stale", "warning"), "drifted-copy-prose": ("stale", "warning"), "shared-code-block": ("stale", "warning"),
    "uneven-copy": ("stale", "warning"), "shared-finding": ("stale", "warning"), "half-accepted-copy": ("stale", "warning"),
    "retired-term": ("defect", "error"), "retired-term-in-url": ("stale", "warning"), "unwritten-content": ("unwritten", "warning"),
    "script-entity": ("defect", "error"), "code-trailing-space": ("defect", "warning"), "placeholder-residue": ("defect", "error"), "prompted-output": ("defect", "warning"),
    "comment-in-block": ("defect", "error"), "code-typography": ("defect", "error"), "mislabeled-dockerfile": ("defect", "warning"), "unused-lang": ("stale", "warning"),
    "unknown-lang": ("defect", "error"), "markdown-in-prose": ("defect", "error"), "flattened-command": ("defect", "error"), "invalid-config": ("defect", "error"),
    "promptless-shell": ("defect", "warning"), "empty-blocks": ("defect", "warning"), "unpaired-output": ("defect", "warning"), "mislabeled-output": ("defect", "error"),
    "digest-mismatch": ("defect", "warning"), "image-mismatch": ("defect", "warning"), "tag-mismatch": ("defect", "warning"), "cross-reference": ("defect", "error"),
    "case-mismatch": ("defect", "error"), "missing-file": ("defect", "error"), "unreferenced-file": ("stale", "warning"), "block-anomaly": ("defect", "error"),
}
#: What a finding is, why it matters and what to do; in our words.
TEXTS = {
    "dead-link": ("An address that is gone.", "Readers meet an error page.", "Link to where the content is now, or drop the link."),
    "dead-image": ("An image that is gone.", "Readers see a hole.", "Store the image anew or drop it."),
    "moved-link": ("An address that has moved for good.", "Redirects end some day.", "Run links --fix."),
    "moved-link-review": ("An address that has moved to a place that may not be its own.", "A redirect to a start page hides a loss.", "Look at the new address before changing the link."),
    "missing-fragment": ("A place in a page that the page doesn't have.", "Readers land at the top.", "Name a place that is there."),
    "temporary-redirect": ("An address that is elsewhere for now.", "It may come back.", "Wait, or link to the place it leads to."),
    "unreachable-link": ("An address that gives no answer.", "It may be down for a moment.", "Check again before changing anything."),
    "retired-term": ("A name that is no longer used.", "Readers look for it in vain.", "Run terms --write; names in code and metadata are for a person."),
    "retired-term-in-url": ("A retired name in an address.", "Renaming it would break links.", "Leave it, and accept it in the ledger."),
    "unwritten-content": ("Text that was never written.", "Readers see a note of the author.", "Write it or take it out."),
    "placeholder-residue": ("A trace of a value that was lost.", "The command does not work as shown.", "Put the value back, with its brackets escaped."),
    "code-trailing-space": ("Code that ends in a blank.", "Something used to follow.", "Put back what is missing or drop the blank."),
    "prompted-output": ("Output behind a prompt.", "Readers would type it.", "Drop the prompt or move the line to an output block."),
    "invalid-config": ("Configuration that can't be parsed.", "Copying it fails.", "Mend it, or mark what is left out."),
    "flattened-command": ("A command that lost its element.", "It reads as prose.", "Put it into code."),
    "markdown-in-prose": ("Markdown that HTML shows as it is.", "Readers see the signs.", "Write the element instead."),
    "script-entity": ("A character reference in a script.", "Nothing decodes it there.", "Write the character itself."),
    "drifted-copy-code": ("Two copies whose code differs.", "One of them is likely out of date.", "Bring them together or accept the pair."),
    "drifted-copy-prose": ("Two copies whose text differs.", "One of them is likely out of date.", "Bring them together or accept the pair."),
    "uneven-copy": ("A finding in one of two copies.", "It was mended in the other.", "Mend it here as well."),
    "shared-finding": ("A finding in both of two copies.", "It was copied along.", "Mend it in both."),
    "half-accepted-copy": ("A finding that is accepted in one of two copies.", "The decision holds for both or for none.", "Accept or mend the other."),
    "case-mismatch": ("A file under a name in another letter case.", "It is not found on other systems.", "Rename it."),
    "missing-file": ("A file that isn't there.", "The lesson has a hole.", "Add it or drop the item."),
    "unreferenced-file": ("A file that no lesson names.", "Nobody reads it.", "Name it or delete it."),
}
CATEGORIES = ("defect", "stale", "unwritten")


def frame(spark: SparkSession) -> DataFrame:
    """(id, category, severity)."""
    return spark.createDataFrame([(k, *v) for k, v in FINDINGS.items()], "id string, category string, severity string")
