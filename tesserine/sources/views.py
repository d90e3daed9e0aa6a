"""Input views over the given tables.

Each view is one SQL text that Spark and the checking engine both accept, so the
two sides read the same rows. Names in braces are other tables or views.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import timeline
from . import snippets

NL = "chr(10)"


def _lit(s: str) -> str:
    """String literal with chr(10) for line breaks, valid in both dialects."""
    return f" || {NL} || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_EXT = _case(f"doc_id % {len(snippets.EXTENSIONS)}", [f"'{e}'" for e in snippets.EXTENSIONS])
_DIR = ("CASE doc_id % 17 WHEN 3 THEN '/tests' WHEN 5 THEN '/node_modules' WHEN 7 THEN '/examples' "
        "WHEN 11 THEN '/.venv' WHEN 2 THEN '/build' ELSE '' END")
_BASE = "CASE WHEN doc_id % 19 = 4 THEN 'config_m' ELSE 'm' END"
_ID = "cast(doc_id AS string)"
_PATH = (f"CASE WHEN doc_id % 23 = 6 THEN 'analyze_' || source || '_m' || {_ID} "
         f"ELSE 'src/' || source || {_DIR} || '/' || {_BASE} || {_ID} END")

PATHS = f"""SELECT doc_id, source AS project, lang, {_PATH} || {_EXT} AS file_path, {_EXT} AS ext, text FROM {{documents}}"""

SNAP_OLD = f"""SELECT project, file_path,
  CASE WHEN doc_id % 7 = 0 THEN content || {NL} || '# older' ELSE content END AS content
  FROM {{corpus}} WHERE doc_id % 10 <> 0"""
SNAP_NEW = "SELECT project, file_path, content FROM {corpus} WHERE doc_id % 11 <> 0"

HIST = """SELECT cast(event_id AS string) AS id, 'user_' || cast(user_id AS string) AS project_name,
  '/p/user_' || cast(user_id AS string) AS project_path, event_type AS analysis_type, props AS result_json,
  ts AS timestamp, value AS duration, '{}' AS metadata_json, event_id FROM {events}"""

TIMINGS = "SELECT event_type AS name, event_id AS iteration, value AS seconds FROM {events}"


def _hits(word: str) -> str:
    return f"((length(content) - length(replace(content, '{word}', ''))) / {len(word)})"


METRICS = f"""SELECT c.project, c.file_path AS key,
  cast(1 + {_hits('if ')} + {_hits('for ')} + {_hits('while ')} AS double) AS cyclomatic_complexity,
  cast({_hits('if ')} + 2 * {_hits('for ')} + {_hits(' and ')} AS double) AS cognitive_complexity,
  cast({_hits('TODO')} + {_hits('eval(')} + c.doc_id % 9 AS int) AS code_smells,
  cast(c.doc_id % 10 AS double) / 20 AS duplication_ratio,
  CASE WHEN c.doc_id % 4 = 3 THEN cast(c.doc_id % 100 AS double)
       WHEN l.quality = 1 THEN 0.8 WHEN l.quality = 0 THEN 0.4 ELSE cast(c.doc_id % 16 AS double) / 10 END AS test_coverage,
  cast(c.doc_id % 6 AS double) / 4 AS documentation_ratio,
  cast({_hits(chr(10)).replace("'" + chr(10) + "'", NL)} + 1 AS int) AS lines_of_code,
  cast(c.doc_id % 13 AS int) AS comment_lines, cast(c.doc_id % 8 AS int) AS blank_lines,
  cast(c.doc_id % 130 AS double) - 10 AS maintainability_index,
  cast(c.doc_id % 25 AS double) / 2 AS technical_debt
  FROM {{corpus}} c LEFT JOIN {{labels}} l ON c.doc_id = l.doc_id"""

_PKG = [
    '{"name":"a","dependencies":{"next":"13.4.1","react":"18.2.0"},"devDependencies":{"typescript":"5.1"},'
    '"scripts":{"dev":"next dev -p 4001"},"engines":{"node":">=18.17"}}',
    '{"name":"b","dependencies":{"vue":"3.3.0"},"devDependencies":{"jest":"29"},"scripts":{"serve":"x --port 5173"}}',
    '{"name":"c","dependencies":{"express":"4.18"},"devDependencies":{},"packageManager":"bun@1.0"}',
    '{"name":"d","dependencies":{"@angular/core":"16.0"},"devDependencies":{"vite":"4.0"}}',
    '{"name":"e","dependencies":{"lodash":"4.17"},"devDependencies":{"nuxt":"3.0"},"scripts":{"start":"node ."}}',
    '{"name":"f","dependencies":{"lodash":"4.17"},"scripts":{"start":"node . -p 6000"},"engines":{"node":"20"}}',
    '{"name":"g","dependencies":{"@angular/core":"15.1"},"engines":{"node":"16.x"}}',
]
_REQ = ["FastAPI==0.100\nuvicorn\n\n# pinned\nredis>=4", "numpy\npandas==2.0\n", "flask\n  # indented\n requests "]
_PYP = ["[tool.poetry]\npython = \">=3.11\"\nfastapi = \"0.100\"", "[project]\nname = 'x'", "python = \"^3.9\"\n"]
_GOM = ["module a\ngo 1.21\nrequire github.com/x-gin/gin v1.9", "module b\ngo 1.20.3\n", "module c\n"]
_ENV = ["PORT=9090\nDB=postgres://x\nNAME=\"quoted\"\nNAME='later'\n# PORT=1\n", "REDIS_URL=redis://r\nKEY=a=b\nnoequals\n",
        " PORT = 7070 \nMONGODB=1\nMYSQL=yes"]


def _pick(values: list[str]) -> str:
    return _case(f"(doc_id + floor(doc_id / 7)) % {len(values)}", [f"({_lit(v)})" for v in values])


MANIFESTS = f"""SELECT *, CASE doc_id % 4 WHEN 1 THEN 'app/' WHEN 3 THEN 'lib/x/' ELSE '' END || file_name AS file_path FROM (SELECT source || '/' || cast(cast(floor(doc_id / 60) AS bigint) AS string) AS project, doc_id,
  CASE doc_id % 7 WHEN 0 THEN 'package.json' WHEN 1 THEN 'requirements.txt' WHEN 2 THEN 'pyproject.toml'
    WHEN 3 THEN 'go.mod' WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'index.html' ELSE 'Cargo.toml' END
    WHEN 5 THEN CASE WHEN doc_id % 3 = 0 THEN 'bun.lockb' ELSE 'pom.xml' END
    ELSE CASE WHEN doc_id % 4 = 0 THEN '.env.local' ELSE '.env' END END AS file_name,
  CASE doc_id % 7 WHEN 0 THEN {_pick(_PKG)} WHEN 1 THEN {_pick(_REQ)} WHEN 2 THEN {_pick(_PYP)}
    WHEN 3 THEN {_pick(_GOM)} WHEN 6 THEN {_pick(_ENV)} ELSE text END AS content
  FROM {{documents}})"""

_TAILS = [
    "\nScore: 8/10 overall\n关键发现\n- finding one\n  - finding two\ntext between\n- finding three\n\n- outside\n改进建议:\n\n"
    "- rec one\n- rec two\n\n- outside",
    "\nReact 17 -> 18\nVue 2.6.1 to 3.2 and Go 1.20 升级到 1.22\nStep 1: back up\nstep 2 upgrade\n步骤3：verify\nlow risk\n推荐路径\n"
    "1. upgrade the core\n- x\n• second long item\nother\n\n- outside item",
    "\nFROM node:22-alpine\nEXPOSE 3000\nuse Postgres\nMulti-Stage\n目标: < 150MB\n最佳实践\n* item a\n2. item b\n\n* outside",
    "\n基础镜像：python:3.12-slim\n端口: 8000\n多阶段构建\n镜像大小: 200-300 MB\n优化\n- slim\n高风险",
    "\n评分 7 / 10\n潜在问题\n- p1\n   \n- outside\n建议\n- r1 is long enough\n4. r2 is long too\n\nmedium risk",
    "",
]
REVIEWS = f"""SELECT conv_id, turn, text || {_case('(conv_id + turn) % 6', [f"({_lit(v)})" for v in _TAILS])} AS text
  FROM {{conversations}}"""


# Text tables whose rows are dear to process, with the column that spreads them.
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id"}
#: A session that sets this gets its text tables dealt out to so many partitions, for inputs of fewer row groups than cores. Unset, nothing is moved.
SPREAD = "tesserine.input.partitions"


class Tables:
    """Lazy views over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            df = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
            asked = self.spark.conf.get(SPREAD, None)
            self._read[name] = df.repartition(int(asked), SPREAD_KEYS[name]) if asked and name in SPREAD_KEYS else df
        return self._read[name]

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        # Braces that do not name a view are part of the text.
        escaped = text.replace("{", "{{").replace("}", "}}")
        for name in views:
            escaped = escaped.replace("{{" + name + "}}", "{" + name + "}")
        return self.spark.sql(escaped, **views)

    def with_snippet(self, documents: DataFrame) -> DataFrame:
        """Also used on a streaming ``documents``."""
        doc = self._sql(PATHS, documents=documents)
        pieces = F.array(*[F.lit(s) for s in snippets.snippet_table()])
        block = F.element_at(pieces, (F.col("doc_id") % snippets.PERIOD + 1).cast("int"))
        return doc.withColumn("content", F.concat("text", F.lit("\n"), block)).drop("text")

    @functools.cached_property
    def corpus(self) -> DataFrame:
        return self.with_snippet(self.table("documents"))

    @functools.cached_property
    def lines(self) -> DataFrame:
        from ..operators.files import explode_lines

        return explode_lines(self.corpus.select("project", "file_path", "ext", "content"))

    @functools.cached_property
    def snap_old(self) -> DataFrame:
        return self._sql(SNAP_OLD, corpus=self.corpus)

    @functools.cached_property
    def snap_new(self) -> DataFrame:
        return self._sql(SNAP_NEW, corpus=self.corpus)

    @functools.cached_property
    def links(self) -> DataFrame:
        from ..operators.graph import page_links

        return page_links(self.table("pages"))

    @functools.cached_property
    def flow(self) -> DataFrame:
        """event_type -> the same user's next event_type, with counts."""
        ev = self.table("events").select("user_id", "event_type", "ts", "event_id")
        nxt = timeline.neighbour(ev, ["user_id"], ["ts", "event_id"], "event_type", "target", "ts", step=1)
        return (nxt.where(F.col("target").isNotNull()).groupBy(F.col("event_type").alias("source"), "target")
                .agg(F.count("*").alias("weight")))

    @functools.cached_property
    def hist(self) -> DataFrame:
        return self._sql(HIST, events=self.table("events"))

    @functools.cached_property
    def timings(self) -> DataFrame:
        return self._sql(TIMINGS, events=self.table("events"))

    @functools.cached_property
    def metrics(self) -> DataFrame:
        return self._sql(METRICS, corpus=self.corpus, labels=self.table("labels"))

    @functools.cached_property
    def manifests(self) -> DataFrame:
        return self._sql(MANIFESTS, documents=self.table("documents"))

    @functools.cached_property
    def reviews(self) -> DataFrame:
        return self._sql(REVIEWS, conversations=self.table("conversations"))

    @functools.cached_property
    def difftext(self) -> DataFrame:
        """A unified diff per change; a change spans at most 200 document ids of one source."""
        doc = self._sql(PATHS, documents=self.table("documents"))
        d = F.col("doc_id")
        head = F.expr(DIFF_HEAD)
        body = F.transform(
            F.split("text", "\n", -1),
            lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), ((i + d) % 3 + 1).cast("int")), x),
        )
        part = doc.select(
            "project", F.expr(CHANGE_ID).alias("change_id"), "doc_id", F.concat(head, F.array_join(body, "\n")).alias("section")
        )
        ordered = F.array_sort(F.collect_list(F.struct("doc_id", "section")))
        return part.groupBy("project", "change_id").agg(
            F.array_join(F.transform(ordered, lambda s: s["section"]), "\n").alias("diff_text")
        )


CHANGE_ID = "project || '#' || cast(cast(floor(doc_id / 200) AS bigint) AS string)"
DIFF_HEAD = f"""'diff --git a/' || file_path || ' b/' || file_path || {NL} ||
  CASE doc_id % 9 WHEN 1 THEN 'new file mode 100644' || {NL} WHEN 2 THEN 'deleted file mode 100644' || {NL}
    WHEN 3 THEN 'rename from old_' || file_path || {NL} ELSE '' END ||
  '--- a/' || file_path || {NL} || '+++ b/' || file_path || {NL} ||
  CASE WHEN doc_id % 16 = 8 THEN '@@ junk @@' WHEN doc_id % 8 = 4 THEN '@@ -5 +7 @@ def x'
    ELSE '@@ -' || cast(doc_id % 50 + 1 AS string) || ',7 +' || cast(doc_id % 40 + 1 AS string) || ',9 @@' END || {NL}"""
