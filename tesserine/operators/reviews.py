"""Structured fields out of free review text. One text is one row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# FIXED VALUES: headings, bullet marks and characters removed in front of an item.
BULLET_KINDS = {
    "findings": dict(heads=["潜在问题", "关键发现"], marks=["-"], lead="", over=-1, patient=False, fold=False),
    "recommendations": dict(heads=["改进建议", "建议"], marks=["-"], lead="", over=-1, patient=True, fold=False),
    "container": dict(heads=["建议", "推荐", "最佳实践", "优化"], marks=["-", "•", "*", "1.", "2.", "3."], lead="-•*1234567890. ", over=0, patient=True, fold=True),
    "framework": dict(heads=["建议", "推荐", "注意", "建议升级", "推荐路径"], marks=["-", "•", "*", "1.", "2.", "3.", "4.", "5."], lead="-•*12345. ", over=5, patient=True, fold=True),
}

# FIXED VALUES: patterns of scores, version changes, steps and deployment fields, and the words of risk levels.
SCORE = r"(\d+)[\s/]*10"
UPGRADE = r"([A-Za-z]+)\s+(\d+[.\d]*)\s*(?:->|to|升级到)\s*(\d+[.\d]*)"
STEP = r"(?:步骤|step)\s*\d+[:：]?\s*([^\n]+)"
RISKS = [("低风险", "low risk", "低"), ("高风险", "high risk", "高"), ("中风险", "medium risk", "中")]
BASE_IMAGE = [r"FROM\s+([a-z0-9/_:.:-]+)", r"(?:基础镜像|推荐镜像)[:：\s]*([a-z0-9/_:.:-]+)"]
PORT = [r"EXPOSE\s*(\d+)", r"(?:端口|PORT)[:：\s]*(\d+)"]
DATABASE = "(数据库|mysql|postgres|mongodb)"
MULTI_STAGE = "(多阶段构建|multi-stage)"
TARGET_SIZE = [r"(?:镜像大小|目标)[:：\s]*(?:<?\s*)?(\d+(?:-\d+)?\s*MB)"]


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def bullets(text: Column, heads: list[str], marks: list[str], lead: str, over: int, patient: bool, fold: bool) -> Column:
    """Bullets after the first heading up to the next blank line (a patient scan waits for an item first)."""
    def step(a, line):
        body = tx.strip(line)
        head = _any([F.contains(F.lower(line) if fold else line, F.lit(h)) for h in heads])
        item = tx.strip(F.ltrim(body, F.lit(lead))) if lead else body
        take = a["on"] & ~a["over"] & ~head & _any([body.startswith(m) for m in marks]) & (F.length(item) > over)
        blank = a["on"] & ~head & (body == "") & ((F.size(a["out"]) > 0) if patient else F.lit(True))
        return F.struct((a["on"] | head).alias("on"), (a["over"] | blank).alias("over"),
                        F.when(take, F.array_append(a["out"], item)).otherwise(a["out"]).cast("array<string>").alias("out"))

    init = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(text, "\n", -1), init, step, lambda a: a["out"])


def review_bullets(reviews: DataFrame) -> DataFrame:
    def rows(kind: str, spec: dict) -> Column:
        return F.transform(bullets(F.col("text"), **spec), lambda s, i: F.struct(F.lit(kind).alias("section"), (i + 1).alias("item_no"), s.alias("item")))

    parts = [rows(k, spec) for k, spec in BULLET_KINDS.items()]
    return reviews.select("conv_id", "turn", F.explode(F.concat(*parts)).alias("b")).select("conv_id", "turn", "b.*")


def review_score(reviews: DataFrame) -> DataFrame:
    raw = F.regexp_extract("text", tx.regex(SCORE), 1)
    return reviews.select("conv_id", "turn", raw.try_cast("int").alias("score"))


def upgrade_triples(reviews: DataFrame) -> DataFrame:
    g = [F.regexp_extract_all("text", F.lit("(?i)" + UPGRADE), F.lit(i)) for i in (1, 2, 3)]
    z = F.transform(F.sequence(F.lit(1), F.size("_n")), lambda i: F.struct(
        i.alias("match_no"), F.element_at("_n", i).alias("name"), F.element_at("_f", i).alias("current_version"), F.element_at("_t", i).alias("recommended_version")))
    base = reviews.select("conv_id", "turn", g[0].alias("_n"), g[1].alias("_f"), g[2].alias("_t")).where(F.size("_n") > 0)
    return base.select("conv_id", "turn", F.explode(z).alias("z")).select("conv_id", "turn", "z.*")


def upgrade_steps(reviews: DataFrame) -> DataFrame:
    steps = F.regexp_extract_all("text", F.lit("(?i)" + STEP), F.lit(1))
    return reviews.select("conv_id", "turn", F.posexplode(steps).alias("p", "s")).select(
        "conv_id", "turn", (F.col("p") + 1).alias("step_no"), tx.strip(F.col("s")).alias("step"))


def risk_keywords(reviews: DataFrame) -> DataFrame:
    low = F.lower("text")
    r = F.coalesce(*[F.when(F.contains(F.col("text"), F.lit(word)) | F.contains(low, F.lit(english)), level) for word, english, level in RISKS])
    return reviews.select("conv_id", "turn", r.alias("risk_level"))


def strategy_fields(reviews: DataFrame) -> DataFrame:
    pick = lambda *rxs: F.coalesce(*[F.nullif(F.regexp_extract("text", "(?i)" + rx, 1), F.lit("")) for rx in rxs])
    hit = lambda rx: F.col("text").rlike("(?i)" + rx)
    return reviews.select("conv_id", "turn", pick(*BASE_IMAGE).alias("base_image"), pick(*PORT).try_cast("int").alias("port"),
                          hit(DATABASE).alias("needs_database"), hit(MULTI_STAGE).alias("multi_stage"), pick(*TARGET_SIZE).alias("target_size"))
