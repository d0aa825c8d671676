"""Command line: inventory, links, copies and terms of a content tree."""

from __future__ import annotations

import argparse
import itertools
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia import catalogue, report, settings
from marginalia.operators import ledger, pairing, prose
from marginalia.operators import links as link_ops
from marginalia.plans.audit import Audit
from marginalia.session import local_session, ship
from marginalia.sources import network


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    p.add_argument("--settings", type=Path)
    commands = p.add_subparsers(dest="command", required=True)
    inventory = commands.add_parser("inventory", help="findings against the ledger")
    inventory.add_argument("--json", action="store_true")
    inventory.add_argument("--blocks", action="store_true", help="the code blocks as JSON")
    inventory.add_argument("--pairs", action="store_true", help="what each output block answers, as JSON")
    inventory.add_argument("--warnings", action="store_true", help="commands that contradict their output, as JSON")
    inventory.add_argument("--anomalies", action="store_true", help="blocks by anomaly, as JSON")
    inventory.add_argument("--lang")
    inventory.add_argument("--flag")
    inventory.add_argument("--category")
    inventory.add_argument("--limit", type=int, default=10)
    links = commands.add_parser("links", help="check links over the network")
    links.add_argument("--owned", action="append", default=[])
    links.add_argument("--json", action="store_true")
    links.add_argument("--markdown", action="store_true")
    links.add_argument("--fix", action="store_true", help="rewrite moved links in place")
    links.add_argument("--dry-run", action="store_true")
    links.add_argument("--limit", type=int, default=10)
    copies = commands.add_parser("copies", help="similar pages")
    copies.add_argument("--json", action="store_true")
    copies.add_argument("--map", action="store_true", help="pairs and drifted pairs between courses")
    copies.add_argument("--limit", type=int, default=10)
    commands.add_parser("images", help="private images and pins behind their tag, over the network")
    terms = commands.add_parser("terms", help="replace retired names in pages")
    terms.add_argument("--write", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if getattr(args, "category", None) not in (None, *catalogue.CATEGORIES):
        print(f"--category must be one of {', '.join(catalogue.CATEGORIES)}")
        return 2
    try:
        loaded = settings.load(args.settings or settings.discover(Path.cwd()))
        book = settings.load_ledger(loaded.ledger)
    except settings.SettingsError as e:
        print(e)
        return 2
    spark = local_session("marginalia-cli", "*")
    ship(spark)
    audit = Audit(spark, loaded)
    try:
        return {"inventory": _inventory, "links": _links, "copies": _copies, "terms": _terms, "images": _images}[args.command](audit, book, args)
    finally:
        audit.close()


def _inventory(audit: Audit, book: settings.Ledger, args: argparse.Namespace) -> int:
    if args.blocks:
        df = audit.blocks.select("block_id", "fingerprint", "lang", "kind", "parse", "code", "shell", "flags", "image_refs", "urls", "runnable", "responds_to", "editor_ref")
        df = df.where(F.col("lang") == args.lang) if args.lang is not None else df
        df = df.where(F.array_contains("flags", args.flag)) if args.flag else df
        print("[", end="")
        for n, r in enumerate(df.orderBy("block_id").select(F.to_json(F.struct("*")).alias("row")).toLocalIterator()):
            print(",\n" * bool(n) + r.row, end="")
        print("]")
        return 0
    if args.pairs or args.warnings or args.anomalies:
        b = audit.blocks
        if args.pairs:
            _print_json(b.where("kind = 'output'").select("block_id", "responds_to", "output_hops", "editor_ref").orderBy("block_id"))
        if args.warnings:
            _print_json(pairing.warnings(b).orderBy("block_id", "rule"))
        if args.anomalies:
            _print_json(b.select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count("*").alias("blocks")).orderBy("anomaly"))
        return 0
    issues = book.frame(audit.spark)
    found = audit.judged(issues).persist()
    try:
        wanted = found.where(F.col("category") == args.category) if args.category else found
        left = ledger.renamed(issues, found.select("problem", "key", "fingerprint"))
        unknown = ledger.unknown(issues, catalogue.frame(audit.spark)).count()
        numbers = {(r.problem, r.state): r["count"] for r in wanted.groupBy("problem", "state").count().collect()}
        if args.json:
            _print_json(wanted.orderBy("problem", F.coalesce("editor_ref", F.lit("")), "key"))
        else:
            print(report.text_report(_first(wanted.where("state <> 'accepted'"), "problem", (F.coalesce("editor_ref", F.lit("")), "key"), args.limit), numbers))
            for r in left.orderBy("problem", "key").toLocalIterator():
                print(f"{r.problem} {r.key}: " + (f"now {r.new_key}" if r.new_key else "resolved"))
            print(", ".join(f"{n} {name}" for name, n in report.totals(numbers).items()))
        return report.exit_code(numbers, left.count(), unknown)
    finally:
        found.unpersist()


def _first(df: DataFrame, group: str, order: tuple, limit: int) -> Iterator[dict]:
    """Rows in order, the first `limit` of each group (0: all), one partition at a time."""
    if limit:
        df = df.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n_") <= limit).drop("n_")
    return (r.asDict() for r in df.orderBy(group, *order).toLocalIterator())


def _print_json(df: DataFrame) -> None:
    """An array of objects, row by row."""
    print("[", end="")
    for n, r in enumerate(df.toLocalIterator()):
        print(",\n" * bool(n) + json.dumps(r.asDict(True), ensure_ascii=False, default=str), end="")
    print("]")


def check_links(audit: Audit, results: DataFrame, args: argparse.Namespace) -> int:
    """Report verdicts over results of checks, rewrite if asked for; 1 if a link is dead or misses its fragment."""
    judged = audit.judged_links(results, tuple(args.owned)).persist()
    counts = {r.verdict: r.links for r in link_ops.verdict_counts(judged).collect()}
    bad = judged.where("verdict <> 'ok'")
    if args.json:
        print(f'{{"checked": {sum(counts.values())}, "counts": {json.dumps(counts)}, "verdicts": ', end="")
        _print_json(judged.orderBy("url"))
        print("}")
    elif args.markdown:
        for line in report.links_markdown(counts, (r.asDict() for r in bad.orderBy(F.array_position(F.array(*map(F.lit, report.LINK_TITLES)), F.col("verdict")), "url").toLocalIterator())):
            print(line)
    else:
        for r in _first(bad, "verdict", ("url",), args.limit):
            print(f"{r['verdict']}  {r['url']}" + (f" -> {r['final_url']}" if r["final_url"] else ""))
        print(", ".join(f"{n} {v}" for v, n in counts.items()))
    if args.fix:
        edits = audit.link_sites().join(link_ops.rewrites(judged), "url").select("file", "raw", "target").distinct().orderBy("file", "raw")
        for file, some in itertools.groupby(edits.toLocalIterator(), key=lambda e: e.file):
            path = audit.settings.root / file
            source = path.read_text(encoding="utf-8")
            new = link_ops.rewritten_text(source, [(e.raw, e.target) for e in some])
            if new != source and not args.dry_run:
                path.write_text(new, encoding="utf-8")
            print(f"{'would rewrite' if args.dry_run else 'rewrote'} {file}" if new != source else f"unchanged {file}")
    judged.unpersist()
    return int(counts.get("dead", 0) + counts.get("fragment", 0) > 0)


def _links(audit: Audit, book: settings.Ledger, args: argparse.Namespace) -> int:
    results = network.link_results(audit.checkable()).persist()
    try:
        return check_links(audit, results, args)
    finally:
        results.unpersist()


def _copies(audit: Audit, book: settings.Ledger, args: argparse.Namespace) -> int:
    pairs = audit.copies().persist()
    totals = pairs.agg(F.count("*").alias("pairs"), F.count_if("in_sync").alias("in_sync"), F.count_if("drifted").alias("drifted")).first().asDict()
    drifted = pairs.where("drifted")
    if args.json:
        print(json.dumps(totals)[:-1] + ', "drift": ', end="")
        _print_json(drifted.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), "a", "b"))
        print("}")
    else:
        ordered = drifted.orderBy(F.desc("score"), "a", "b")
        for p in (ordered.limit(args.limit) if args.limit else ordered).toLocalIterator():
            print(f"{p.score:.4f}  {p.a} :: {p.b}", *(f"  < {s}" for s in p.only_a[:3]), *(f"  > {s}" for s in p.only_b[:3]), sep="\n")
        print(f"{totals['pairs']} pairs, {totals['in_sync']} in sync, {totals['drifted']} drifted")
        if args.map:
            files = audit.items.select("base", "course_dir").distinct()
            by = pairs.join(files.toDF("a", "course_a"), "a").join(files.toDF("b", "course_b"), "b").groupBy(F.least("course_a", "course_b").alias("x"), F.greatest("course_a", "course_b").alias("y")).agg(F.count("*").alias("pairs"), F.count_if("drifted").alias("drifted"))
            for r in by.orderBy("x", "y").toLocalIterator():
                print(f"{r.x} - {r.y}: {r.pairs} pairs, {r.drifted} drifted")
    pairs.unpersist()
    return 0


def _terms(audit: Audit, book: settings.Ledger, args: argparse.Namespace) -> int:
    """Only open names in the prose of pages are replaced; the others are counted with the reason why they are left."""
    counts, files = dict.fromkeys(prose.BUCKETS, 0), 0
    for r in audit.term_edits(book.frame(audit.spark)).toLocalIterator():
        files += 1
        for bucket in counts:
            counts[bucket] += r[bucket]
        if args.write and r.changed and r.place == "page":
            path = audit.settings.root / r.found
            if path.read_text(encoding="utf-8") == r.html:
                path.write_text(r.source_new, encoding="utf-8")
            else:
                counts["refused"] += r.changed
                counts["changed"] -= r.changed
    print(json.dumps({"files": files, **counts, "written": args.write}))
    return 0


def check_images(audit: Audit, results: DataFrame, drift: DataFrame, now: Column) -> int:
    """Report private images and pins behind their tag; 1 if there are offenders, idle permissions or more stale pins than the budget."""
    offenders, idle = audit.private_images(results)
    bad = 0
    for r in offenders.orderBy("course_dir", "ref").toLocalIterator():
        print(f"private  {r.course_dir}  {r.ref}")
        bad = 1
    for r in idle.orderBy("course_dir").toLocalIterator():
        print(f"idle permission  {r.course_dir}")
        bad = 1
    states = audit.drift(drift, now).persist()
    for r in states.where("status = 'stale'").orderBy(F.desc("age_days"), "ref").toLocalIterator():
        print(f"stale  {r.ref}  {r.age_days} days")
    counts = {r.status: r["count"] for r in states.groupBy("status").count().collect()}
    states.unpersist()
    print(", ".join(f"{counts.get(s, 0)} {s}" for s in ("current", "behind", "stale", "unknown")))
    return int(bad or counts.get("stale", 0) > audit.settings.stale_budget)


def _images(audit: Audit, book: settings.Ledger, args: argparse.Namespace) -> int:
    refs = audit.image_sites().select("ref")
    results, drift = network.image_results(refs).persist(), network.drift_results(refs).persist()
    try:
        return check_images(audit, results, drift, F.current_timestamp())
    finally:
        results.unpersist()
        drift.unpersist()


if __name__ == "__main__":
    raise SystemExit(main())
