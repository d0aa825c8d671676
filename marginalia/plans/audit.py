"""The audit of a content tree: every finding with its identity, against the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import catalogue
from marginalia.functions import html, text, urls
from marginalia.operators import blocks as block_ops
from marginalia.operators import copies, images, ledger, links, pairing, paths, prose
from marginalia.operators.skew import large
from marginalia.session import written
from marginalia.settings import Settings
from marginalia.sources import tree

#: Findings about copies, which aren't sought in the twin of a copy.
ABOUT_COPIES = ("drifted-copy-code", "drifted-copy-prose", "shared-code-block")
FINDING = ("problem", "key", "fingerprint", "match", "editor_ref", "url")


class Audit:
    """The relations of a tree; each is made once and kept while the audit runs."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings, root = spark, settings, str(settings.root)
        self._copies: DataFrame | None = None
        self._findings: DataFrame | None = None
        self.courses = tree.courses(spark, root).persist()
        named = tree.items(self.courses)
        self.files = tree.pages(spark, root)
        # Content under a name of another letter case is still read.
        self.resolved = paths.resolved(named, self.files.select("path")).persist()
        self.items = self.resolved.where("found is not null").join(self.files.select(F.col("path").alias("found"), "html"), "found").withColumn("base", F.concat_ws("/", "course_dir", "lesson_slug", "item_id")).persist()
        rows = self.items.select("course_dir", "lesson_slug", "item_id", "base", "found", "lesson_url", F.explode(html.block_rows(F.col("html"))).alias("b"))
        rows = rows.select("*", "b.*").drop("b").withColumn("block_id", F.concat_ws("#", "base", "ordinal")).withColumn("editor_ref", F.concat_ws(":", "found", "line", "column"))
        classified = block_ops.classified(rows, settings.kinds(spark), settings.registry_pattern, settings.non_image_namespaces).withColumn("fingerprint", text.fingerprint("code"))
        self.blocks = pairing.linked(classified, ("course_dir", "lesson_slug", "item_id")).persist()

    def close(self) -> None:
        for df in (self.blocks, self.items, self.resolved, self.courses):
            df.unpersist()

    def _of_blocks(self, problem: str, df: DataFrame, match: Column, suffix: Column | None = None) -> DataFrame:
        key = F.col("block_id") if suffix is None else F.concat("block_id", F.lit("::"), suffix)
        return df.select(F.lit(problem).alias("problem"), key.alias("key"), "fingerprint", match.cast("string").alias("match"), "editor_ref", F.col("lesson_url").alias("url"))

    def block_findings(self) -> list[DataFrame]:
        b, code = self.blocks, F.col("code")
        chars = b.select("*", F.explode(block_ops.typography(code)).alias("char"))
        residue = block_ops.residue(b)
        warnings = pairing.warnings(b).join(b.select("block_id", "fingerprint", "editor_ref", "lesson_url"), "block_id")
        has = lambda flag: F.array_contains("flags", flag)
        out = [
            self._of_blocks("comment-in-block", b.withColumn("c", block_ops.comment_in_block(F.col("raw_code"))).where("c is not null"), F.col("c")),
            self._of_blocks("code-typography", chars, F.col("char"), F.col("char")),
            self._of_blocks("mislabeled-dockerfile", b.where((F.col("lang") != "dockerfile") & block_ops.opens_as_dockerfile(code)), F.col("lang")),
            self._of_blocks("placeholder-residue", residue, F.col("match"), F.col("rule")),
            self._of_blocks("unknown-lang", b.where(has("unknown-lang")), F.col("lang")),
            self._of_blocks("invalid-config", b.where("parse.status = 'invalid'"), F.col("parse.error")),
            self._of_blocks("unpaired-output", b.where("unpaired"), F.lit(None)),
            self._of_blocks("mislabeled-output", b.where(has("mislabeled-output")), F.lit(None)),
            self._of_blocks("promptless-shell", b.where(has("no-prompt")), F.lit(None)),
            self._of_blocks("empty-blocks", b.where(has("empty")), F.lit(None)),
            self._of_blocks("block-anomaly", b.select("*", F.explode("anomalies").alias("a")).where(F.col("a").isin(*self.settings.anomalies or ("",))), F.col("a"), F.col("a")),
        ]
        out += [self._of_blocks(rule, warnings.where(F.col("rule") == rule), F.lit(None), F.lit(rule)) for rule in ("digest-mismatch", "image-mismatch", "tag-mismatch")]
        return out

    def prompted_output(self) -> DataFrame:
        """Commands that begin like output: the first token stands twice or more in output and at most twice in commands."""
        b = self.blocks
        lines = b.where("kind = 'output'").select(F.explode(text.lines("code")).alias("l")).unionByName(b.where("shell is not null").select(F.explode("shell.output").alias("l")))
        seen = lines.select(text.first_token("l").alias("token")).where("token <> ''").groupBy("token").count().where("count >= 2").select("token")
        commands = b.where("shell is not null").select("*", F.explode("shell.commands").alias("command")).withColumn("token", text.first_token("command"))
        rare = commands.groupBy("token").count().where("count <= 2").select("token")
        return self._of_blocks("prompted-output", commands.join(seen, "token", "left_semi").join(rare, "token", "left_semi"), text.shorten("command"), F.col("token"))

    def unused_lang(self) -> DataFrame:
        df = self.settings.kinds(self.spark).join(self.blocks.select("lang"), "lang", "left_anti")
        none = F.lit(None).cast("string")
        return df.select(F.lit("unused-lang").alias("problem"), F.col("lang").alias("key"), none.alias("fingerprint"), F.col("lang").alias("match"), none.alias("editor_ref"), none.alias("url"))

    def _of_items(self, problem: str, rows: DataFrame, name: str, rule: Column | None = None) -> DataFrame:
        """Rows of items with `match` and its `offset` in the source, numbered an item in their order `seq`; `print` is what the fingerprint is taken of."""
        n = F.row_number().over(Window.partitionBy("base", *(["rule"] if rule is not None else [])).orderBy("seq")) - 1
        at = text.line_and_column("html", F.greatest("offset", F.lit(0)))
        key = F.concat("base", F.lit(f"#{name}"), n.cast("string"), *([F.lit("::"), rule] if rule is not None else []))
        return rows.select(F.lit(problem).alias("problem"), key.alias("key"), text.fingerprint("print" if "print" in rows.columns else "match").alias("fingerprint"), "match", F.concat_ws(":", "found", at["line"], at["column"]).alias("editor_ref"), F.col("lesson_url").alias("url"))

    def prose_findings(self) -> list[DataFrame]:
        i, source = self.items, F.col("html")
        marked = i.select("*", F.posexplode(prose.markdown(source)).alias("seq", "m")).select("*", "m.*")
        flat = i.select("*", F.posexplode(prose.flattened_commands(source)).alias("seq", "e")).select("*", "e.*")
        drafts = i.select("*", F.posexplode(prose.unwritten(source)).alias("seq", "u")).select("*", "u.*")
        scripts = i.select("*", F.posexplode(html.script_rows(source)).alias("seq", "s")).withColumns({"match": F.col("s.entity"), "offset": F.col("s.start"), "print": F.col("s.body")})
        return [
            self._of_items("markdown-in-prose", marked, "prose", F.col("rule")),
            self._of_items("flattened-command", flat, "command"),
            self._of_items("unwritten-content", drafts, "unwritten", F.col("rule")),
            self._of_items("script-entity", scripts, "script"),
            self._of_items("code-trailing-space", self.inline_code().where(block_ops.ends_in_blank(F.col("match"))), "code"),
            self.template_values(),
        ]

    def inline_code(self) -> DataFrame:
        """Code elements outside blocks, with their place in the item (seq, offset) and text (match)."""
        return self.items.select("*", F.explode(html.inline_rows(F.col("html"))).alias("c")).withColumns({"seq": F.col("c.ordinal"), "offset": F.col("c.start"), "match": F.col("c.text")})

    def template_values(self) -> DataFrame:
        """Placeholders in the metadata documents of courses, by file and path."""
        docs = [self.courses.select("course_dir", "url", F.lit(name).alias("file"), F.col(f"{name}_doc").alias("doc")) for name in ("details", "published")]
        df = docs[0].unionByName(docs[1]).select("*", F.explode(prose.json_templates(F.col("doc"))).alias("t"))
        at = text.line_and_column("doc", F.greatest(F.instr("doc", F.col("t.value")) - 1, F.lit(0)))
        ref = F.concat(F.lit("courses/"), "course_dir", F.lit("/"), "file", F.lit(".json:"), at["line"].cast("string"), F.lit(":"), at["column"].cast("string"))
        key = F.concat_ws("#", "course_dir", F.when(F.col("file") == "details", F.col("t.path")).otherwise(F.concat_ws(".", "file", "t.path")))
        return df.select(F.lit("unwritten-content").alias("problem"), key.alias("key"), text.fingerprint("t.value").alias("fingerprint"), F.col("t.value").alias("match"), ref.alias("editor_ref"), "url")

    def term_hits(self) -> DataFrame:
        """Retired names in pages and metadata: a finding each, with where it stands (place: page or a metadata file; found, html, offset, term, in_code)."""
        terms = self.settings.terms
        fields = self.courses.select(F.col("course_dir").alias("base"), F.lit("details.json").alias("place"), F.explode(F.array("details.title", "details.short_description", "details.long_description_html")).alias("html"), F.col("url").alias("lesson_url"), F.concat(F.lit("courses/"), "course_dir", F.lit("/details.json")).alias("found"))
        lessons = self.courses.select("course_dir", "url", F.explode("lessons").alias("l"))
        meta = lessons.select(F.concat_ws("/", "course_dir", "l.slug").alias("base"), F.lit("lessons-meta.json").alias("place"), F.explode(F.array("l.title", "l.description_html")).alias("html"), F.col("url").alias("lesson_url"), F.concat(F.lit("courses/"), "course_dir", F.lit("/lessons-meta.json")).alias("found"))
        pages = self.items.select("base", F.lit("page").alias("place"), "html", "lesson_url", "found")
        rows = pages.unionByName(fields).unionByName(meta).where("html is not null").withColumn("hits", prose.retired(F.col("html"), terms)).where("size(hits) > 0")
        # Masked once a source, not once a hit.
        rows = rows.withColumn("prose", html.prose_mask(F.col("html"))).select("*", F.explode("hits").alias("r")).select("*", "r.*").drop("r", "hits")
        # The words around it, between the walls of its paragraph.
        start = F.greatest(F.col("offset") - 39, F.lit(1))
        in_code = text.flatten_blanks(F.regexp_replace(F.substring("html", start, F.length("match") + 80), r"<[^>]*>|<[^>]*$|^[^<]*>", " "))
        rows = rows.withColumn("context", F.when(F.col("in_code"), in_code).otherwise(prose.context(F.col("prose"), F.col("offset"), F.length("match"))))
        n = F.row_number().over(Window.partitionBy("base", "term", "context").orderBy("place", "offset"))
        name = F.concat("base", F.lit("#term "), "term", F.lit(": "), "context")
        at = text.line_and_column("html", F.col("offset"))
        ref = F.when(F.col("place") == "page", F.concat_ws(":", "found", at["line"], at["column"])).otherwise(F.concat("found", F.lit(":1:1")))
        key = F.when(n > 1, F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(name)
        return rows.select(F.lit("retired-term").alias("problem"), key.alias("key"), text.fingerprint("context").alias("fingerprint"), "match", ref.alias("editor_ref"), F.col("lesson_url").alias("url"), "place", "found", "html", "offset", "term", "in_code")

    def term_findings(self) -> list[DataFrame]:
        terms = self.settings.terms
        if not terms:
            return []
        lessons = self.courses.select("course_dir", "url", F.explode("lessons").alias("l"))
        slugs = lessons.select("course_dir", F.col("l.slug").alias("slug"), "url").unionByName(self.courses.select("course_dir", F.explode(F.map_values("slugs")).alias("slug"), "url"))
        slugs = slugs.distinct().select("*", F.explode(prose.retired_in_slug(F.col("slug"), terms)).alias("term"))
        in_slug = slugs.select(F.lit("retired-term-in-url").alias("problem"), F.concat("course_dir", F.lit("/"), "slug", F.lit("#"), "term").alias("key"), text.fingerprint("slug").alias("fingerprint"), F.col("slug").alias("match"), F.concat(F.lit("courses/"), "course_dir", F.lit("/lessons-meta.json:1:1")).alias("editor_ref"), "url")
        return [self.term_hits().select(*FINDING), in_slug]

    def term_edits(self, issues: DataFrame) -> DataFrame:
        """(found, place, html, source_new and a number for each of prose.BUCKETS) of pages and metadata with retired names."""
        hits = ledger.applied(self.term_hits(), issues)
        hit = F.struct("term", "offset", "match", "in_code", (F.col("state") == "accepted").alias("accepted"), (F.col("place") != "page").alias("metadata"))
        by = hits.groupBy("found", "place", "html").agg(F.array_sort(F.collect_set(hit)).alias("hits"))
        return prose.rewritten(by, "html", "hits", self.settings.terms).drop("hits")

    def file_findings(self) -> list[DataFrame]:
        none = F.lit(None).cast("string")
        states = {"case-mismatch": "case-mismatch", "missing": "missing-file"}
        out = [self.resolved.where(F.col("status") == s).select(F.lit(p).alias("problem"), F.col("path").alias("key"), none.alias("fingerprint"), F.col("found").alias("match"), F.concat("path", F.lit(":1:1")).alias("editor_ref"), F.col("lesson_url").alias("url")) for s, p in states.items()]
        lost = paths.unreferenced(self.resolved.select("path"), self.files)
        return [*out, lost.select(F.lit("unreferenced-file").alias("problem"), F.col("path").alias("key"), none.alias("fingerprint"), none.alias("match"), F.concat("path", F.lit(":1:1")).alias("editor_ref"), none.alias("url"))]

    def copies(self) -> DataFrame:
        """Similar pages with what they have alone; found once."""
        if self._copies is None:
            self._copies = written(self._compared())
        return self._copies

    def _seen(self) -> DataFrame:
        """(id, text, found, lesson_url) of the texts that are compared."""
        return self.items.select(F.col("base").alias("id"), html.visible_column(F.col("html"), tuple(self.settings.ignore_elements)).alias("text"), "found", "lesson_url")

    def _compared(self) -> DataFrame:
        seen = self._seen().select("id", "text")
        docs = copies.documents(seen, "id", "text", self.settings.shingle_size, self.settings.min_words)
        return copies.drift(copies.similar_pairs(docs, self.settings.threshold), seen, "id", "text")

    def copy_findings(self) -> list[DataFrame]:
        """Copies that drifted apart in code or in prose, and code that stands in several courses."""
        seen = large(self._seen().withColumn("words", text.words("text")))
        pairs = self.copies().where("drifted").join(seen.select(F.col("id").alias("a"), F.col("words").alias("wa"), "found", "lesson_url"), "a").join(seen.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        a, b = F.col("a"), F.col("b")
        drifted = pairs.select(
            F.when(F.col("touches_code"), "drifted-copy-code").otherwise("drifted-copy-prose").alias("problem"),
            copies.pair_key(a, b).alias("key"),
            copies.pair_fingerprint(a, F.col("wa"), b, F.col("wb")).alias("fingerprint"),
            F.round("score", 4).cast("string").alias("match"),
            F.concat("found", F.lit(":1:1")).alias("editor_ref"),
            F.col("lesson_url").alias("url"),
        )
        keyed = self.blocks.select("course_dir", "editor_ref", "lesson_url", text.code_key("code").alias("code_key")).where(text.worth_tracking("code_key"))
        groups = keyed.groupBy("code_key").agg(F.count_distinct("course_dir").alias("courses"), F.min(F.struct("editor_ref", "lesson_url")).alias("first")).where("courses > 1")
        prints = text.fingerprint("code_key")
        shared = groups.select(F.lit("shared-code-block").alias("problem"), prints.alias("key"), prints.alias("fingerprint"), text.shorten("code_key").alias("match"), F.col("first.editor_ref").alias("editor_ref"), F.col("first.lesson_url").alias("url"))
        return [drifted, shared]

    def sibling_findings(self, judged: DataFrame) -> DataFrame:
        """(problem, rule, file, twin): findings that one of two similar pages has and the other not, both have, or one has accepted; not of findings about copies."""
        of = self.items.select("base", "found").distinct()
        pairs = self.copies().select("a", "b").join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        files = judged.where(F.col("editor_ref").isNotNull() & ~F.col("problem").isin(*ABOUT_COPIES)).select("problem", F.regexp_replace("editor_ref", r":\d+:\d+$", "").alias("file"), (F.col("state") == "accepted").alias("accepted"))
        return copies.sibling_findings(files, copies.sibling_files(pairs))

    def sibling_rows(self, judged: DataFrame) -> DataFrame:
        """`sibling_findings` as findings: the key names what was found and both files."""
        named = judged.withColumn("file", F.regexp_replace("editor_ref", r":\d+:\d+$", ""))
        prints = named.groupBy(F.col("problem").alias("of"), "file", (F.col("state") == "accepted").alias("done")).agg(F.min("fingerprint").alias("fingerprint"), F.min(F.struct("editor_ref", "url")).alias("first"))
        df = self.sibling_findings(judged).select(F.col("problem").alias("of"), F.col("rule").alias("problem"), "file", "twin").withColumn("done", F.col("problem") == "half-accepted-copy")
        df = df.join(prints, ["of", "file", "done"])
        key = F.concat("of", F.when(F.col("done"), " accepted ").otherwise(" "), copies.pair_key(F.col("file"), F.col("twin")))
        return df.select("problem", key.alias("key"), "fingerprint", F.col("of").alias("match"), F.col("first.editor_ref").alias("editor_ref"), F.col("first.url").alias("url")).dropDuplicates(["problem", "key"])

    def link_sites(self) -> DataFrame:
        """(url, kind, file, raw, text, key, fingerprint, editor_ref, lesson_url) of every link and image."""
        rows = self.items.select("base", "found", "html", "lesson_url", F.explode(html.link_rows(F.col("html"))).alias("l")).select("*", "l.*")
        at = text.line_and_column("html", F.col("start"))
        return rows.select("url", "kind", F.col("found").alias("file"), "raw", "text", F.concat("base", F.lit("#"), "kind", F.col("ordinal").cast("string")).alias("key"), text.fingerprint("raw").alias("fingerprint"), F.concat_ws(":", "found", at["line"], at["column"]).alias("editor_ref"), "lesson_url")

    def checkable(self) -> DataFrame:
        """(url) of the distinct addresses that are checked."""
        sites = self.link_sites()
        return sites.where((urls.scheme("url") == "http") & urls.skip_reason("url", self.settings.skip).isNull()).select("url").distinct()

    def judged_links(self, results: DataFrame, owned: tuple[str, ...] = ()) -> DataFrame:
        return links.judged(results, (*self.settings.owned_domains, *owned), self.link_sites().where(urls.scheme("url") == "http").select("url"))

    def link_findings(self, results: DataFrame, owned: tuple[str, ...] = ()) -> DataFrame:
        """Addresses with a problem as findings, each with its first place; results as of `network.link_results`."""
        sites = self.link_sites()
        found = links.problems(self.judged_links(results, owned), sites)
        first = sites.groupBy("url").agg(F.min(F.struct("editor_ref", "lesson_url")).alias("first"))
        none = F.lit(None).cast("string")
        return found.join(first, "url").select("problem", F.col("url").alias("key"), none.alias("fingerprint"), F.concat_ws(" ", "url", F.concat(F.lit("in "), "files", F.lit(" files"))).alias("match"), F.col("first.editor_ref").alias("editor_ref"), F.col("first.lesson_url").alias("url"))

    def image_sites(self) -> DataFrame:
        """(ref, course_dir, block_id, editor_ref) of every image reference in a block."""
        return self.blocks.select(F.explode("image_refs").alias("ref"), "course_dir", "block_id", "editor_ref")

    def drift(self, results: DataFrame, now: Column) -> DataFrame:
        """Pinned references with status and age; results as of `network.drift_results`."""
        return images.drift_status(results, now, self.settings.stale_image_days)

    def private_images(self, results: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(offenders, idle) of `images.private_images` for results as of `network.image_results`."""
        allowed = self.spark.createDataFrame([(c,) for c in self.settings.allowed_private], "course_dir string")
        return images.private_images(results.join(self.image_sites().select("ref", "course_dir").distinct(), "ref"), allowed)

    def findings(self) -> DataFrame:
        """All findings; found once, group by group, so that no plan grows with their number."""
        if self._findings is None:
            groups = (self.block_findings(), [self.prompted_output(), self.unused_lang()], self.prose_findings(), self.term_findings(), self.file_findings(), self.copy_findings())
            out = None
            for parts in filter(None, groups):
                part = parts[0].select(*FINDING)
                for p in parts[1:]:
                    part = part.unionByName(p.select(*FINDING))
                part = written(part)
                out = part if out is None else out.unionByName(part)
            self._findings = out
        return self._findings

    def judged(self, issues: DataFrame, results: DataFrame | None = None) -> DataFrame:
        """Findings with category, severity and state, those about copies of other findings included; with results of links, also theirs."""
        own = self.findings() if results is None else self.findings().unionByName(self.link_findings(results).select(*FINDING))
        first = written(ledger.applied(own, issues))
        known = catalogue.frame(self.spark).withColumnRenamed("id", "problem")
        both = first.unionByName(ledger.applied(self.sibling_rows(first), issues).select(*first.columns))
        return both.join(F.broadcast(known), "problem", "left")
