"""Statements of a vault: Markdown notes in a folder, each with front-matter and ``##`` sections."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NodeExists, NodeNotFound, QueryError
from ..functions.embed import embedded
from ..operators import writes as W
from ..sources import notes as N
from ..storage import materialise

_FRONT = re.compile(r"\A---\n(.*?)\n---\n", re.S)


def note_slug(title: str) -> str:
    """The same as ``functions.text.slug`` for one title."""
    s = re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")
    return f"{s[:33]}_{hashlib.sha256(title.encode()).hexdigest()[:6]}" if len(s) > 40 else s


def with_front(text: str, **values: str) -> str:
    """``text`` with these lines of its front-matter set; the others stay."""
    m = _FRONT.match(text)
    lines = m[1].split("\n") if m else []
    for key, value in values.items():
        line = f"{key}: {value}"
        at = next((i for i, x in enumerate(lines) if x.startswith(f"{key}:")), None)
        lines = [*lines, line] if at is None else [*lines[:at], line, *lines[at + 1 :]]
    return "---\n" + "\n".join(lines) + "\n---\n" + (text[m.end() :] if m else text)


def with_section(text: str, section: str, content: str, append: bool = False) -> str:
    """``text`` with one ``##`` section replaced or added to; a section it lacks goes to the end. Case doesn't tell sections apart."""
    parts = re.split(r"(?m)^(## .*)$", text)
    for i in range(1, len(parts), 2):
        if parts[i][3:].strip().lower() == section.lower():
            held = parts[i + 1].strip("\n")
            parts[i + 1] = "\n" + (f"{held}\n{content}" if append and held else content) + "\n\n"
            return "".join(parts).rstrip("\n") + "\n"
    return f"{text.rstrip()}\n\n## {section}\n{content}\n"


class VaultStatements:
    """Part of ``Engine``; ``vault`` is the folder."""

    def _file(self, title: str, new: bool = False) -> Path:
        if self.vault is None:
            raise QueryError("the engine has no vault")
        name = note_slug(title)
        if not name:
            raise QueryError(f"{title!r} can't name a note")
        path = Path(self.vault) / f"{name}.md"
        if new and path.exists():
            raise NodeExists(name)
        if not new and not path.exists():
            raise NodeNotFound(name)
        return path

    def _stamp(self) -> str:
        return datetime.fromtimestamp(self._now() / 1000, UTC).isoformat(timespec="seconds")

    def _one_note(self, path: Path) -> DataFrame:
        return self.catalog.nodes.sparkSession.createDataFrame([(path.stem, path.read_text("utf-8"))], "note string, text string")

    def _vault_new(self, title, kind, tags, summary="") -> DataFrame:
        path = self._file(title, new=True)
        path.parent.mkdir(parents=True, exist_ok=True)
        names = [t.strip() for t in (tags or "").split(",") if t.strip()]
        front = with_front("", kind=kind or "memory", tags="[" + ", ".join(names) + "]", created=self._stamp(), updated=self._stamp(), status="active")
        path.write_text(f"{front}\n## Summary\n{summary}\n\n## Body\n\n## Links\n", "utf-8")
        return self._one_note(path)

    def _vault_read(self, title) -> DataFrame:
        return self._one_note(self._file(title))

    def _vault_write(self, title, section, content, append=False) -> DataFrame:
        path = self._file(title)
        path.write_text(with_front(with_section(path.read_text("utf-8"), section, content, append), updated=self._stamp()), "utf-8")
        return self._one_note(path)

    def _vault_append(self, title, section, content) -> DataFrame:
        return self._vault_write(title, section, content, append=True)

    def _vault_daily(self) -> DataFrame:
        day = self._stamp()[:10]
        try:
            return self._one_note(self._file(day))
        except NodeNotFound:
            return self._vault_new(day, "daily", None, f"Daily note for {day}")

    def _vault_archive(self, title) -> DataFrame:
        path = self._file(title)
        path.write_text(with_front(path.read_text("utf-8"), status="archived", updated=self._stamp()), "utf-8")
        return self._one_note(path)

    def _vault_sync(self) -> DataFrame:
        """Nodes of kind ``note`` and ``links`` edges as the folder has them; notes that are gone go."""
        if self.vault is None:
            raise QueryError("the engine has no vault")
        c, spark = self.catalog, self.catalog.nodes.sparkSession
        files = N.notes(spark, f"{self.vault}/*.md") if any(Path(self.vault).glob("*.md")) else spark.createDataFrame([], "id string, path string, title string, front string, body string")
        found = materialise(files, "notes")
        front = lambda key: F.regexp_extract("front", rf"(?m)^{key}: *(.*)$", 1)
        about = F.regexp_extract("body", r"(?si)(?:\A|\n)## Summary *\n\s*(.*?)\s*(?=\n## |\z)", 1)
        now = F.lit(self._now())
        rows = found.select("id", F.lit("note").alias("kind"), "title", front("kind").alias("note_kind"), front("tags").alias("tags"), front("status").alias("status"), about.alias("summary"), now.alias("__created_at__"), now.alias("__updated_at__"))
        old = c.nodes.filter(F.col("kind") == "note").select("id")
        gone = materialise(old.join(found, "id", "left_anti"), "gone")
        self.catalog = W.delete_nodes(c, gone)
        c = self.catalog
        edges = W.delete_edges(c, F.col("kind") == "links").edges
        texts = found.select("id", F.col("body").alias("text"))
        more = {"documents": texts if c.documents is None else c.documents.join(texts, "id", "left_anti").unionByName(texts, allowMissingColumns=True)}
        if self.embed is not None:
            fresh = materialise(embedded(texts, self.embed), "vectors")
            more["vectors"] = fresh if c.vectors is None else c.vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).join(fresh, "id", "left_anti").unionByName(fresh)
        self.catalog = c.with_tables(nodes=W.widened(c.nodes.join(found, "id", "left_anti").select(c.nodes.columns), rows), edges=edges, **more)
        self._link(N.links(found).withColumn("weight", F.lit(1.0)))
        return found.agg(F.count(F.lit(1)).alias("notes"))

    def _notes_only(self) -> DataFrame:
        return self.nodes.filter(F.col("kind") == "note")

    def _vault_search(self, text, limit, rule) -> DataFrame:
        """The nearest notes, or those whose summary has the text if there is no embedder."""
        from ..catalog import public

        notes = self._where(rule, self._notes_only())
        if self.embed is None or self.catalog.vectors is None:
            return public(notes.filter(F.col("summary").contains(text)).orderBy("id").limit(limit or 10)) if "summary" in notes.columns else public(notes.limit(0))
        near = notes.join(self._similar_scores(text), "id").withColumn("_similarity_score", F.round("__similarity", 4))
        return public(near.orderBy(F.desc("_similarity_score"), "id").limit(limit or 10))

    def _vault_backlinks(self, title) -> DataFrame:
        return N.backlinks(self.catalog.edges, f"note:{note_slug(title)}")

    def _vault_list(self, rule, order, limit) -> DataFrame:
        from ..catalog import public
        from ..operators.predicates import order_by

        out = self._where(rule, self._notes_only())
        out = out.orderBy(*order_by(out, *order)) if order else out.orderBy("id")
        return public(out.limit(limit) if limit is not None else out)
