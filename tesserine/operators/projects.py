"""Project classification from manifests: (project, file_name, content) rows, with file_path where a project may have several of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import BASE_IMAGES, DEFAULT_PORTS

_FILES = ["package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", ".env", "bun.lock", "bun.lockb"]
UNSTATED = "未指定"  # fixed value: shown where a manifest names no version
KEY_DEPENDENCIES = ["react", "vue", "next", "angular", "express", "nestjs", "typescript"]


def _wide(manifests: DataFrame) -> DataFrame:
    """One row per project with the text of each known manifest: of several with one name, that nearest to the project's root, then the first by path."""
    path = F.col("file_path") if "file_path" in manifests.columns else F.col("file_name")
    nearest = F.struct(F.size(F.split(path, "/")), path, "content")
    return manifests.groupBy("project").agg(
        *[F.min_by("content", F.when(F.col("file_name") == f, nearest)).alias(f.replace(".", "_")) for f in _FILES],
        F.bool_or(F.col("file_name").endswith(".html")).alias("html"))


def _has(col: str) -> Column:
    return F.col(col).isNotNull()


def _type() -> Column:
    deps = F.coalesce(F.get_json_object("package_json", "$.dependencies"), F.lit("{}"))
    every = F.concat(deps, F.coalesce(F.get_json_object("package_json", "$.devDependencies"), F.lit("{}")))
    has = lambda t, w: F.contains(t, F.lit(w))
    node = (F.when(has(deps, "next"), "nextjs").when(has(every, "nuxt"), "nuxt").when(has(deps, "react") | has(every, "vite"), "react")
            .when(has(deps, "vue"), "vue").when(has(deps, "@angular/core"), "angular").when(has(deps, "express"), "express").otherwise("node"))
    low = lambda c: F.coalesce(F.lower(c), F.lit(""))
    fast = has(low("requirements_txt"), "fastapi") | has(low("pyproject_toml"), "fastapi")
    return (F.when(_has("package_json"), node)
            .when(_has("requirements_txt") | _has("pyproject_toml"), F.when(fast, "fastapi").otherwise("python"))
            .when(_has("go_mod"), F.when(has(low("go_mod"), "gin"), "gin").otherwise("go")).when(_has("Cargo_toml"), "rust")
            .when(_has("pom_xml") | _has("build_gradle"), "java").when(F.col("html"), "static").otherwise("unknown"))


def project_type(manifests: DataFrame) -> DataFrame:
    meta = (F.when(_has("pyproject_toml"), "python").when(_has("package_json"), "node").when(_has("go_mod"), "go")
            .when(_has("pom_xml"), "java-maven").when(_has("Cargo_toml"), "rust").otherwise("unknown"))
    return _wide(manifests).select("project", _type().alias("project_type"), meta.alias("build_type"), _has("requirements_txt").alias("has_requirements"))


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    lines = F.filter(F.transform(F.split("content", "\n", -1), lambda x: tx.strip(x)), lambda x: (x != "") & ~x.startswith("#"))
    py = manifests.where(F.col("file_name") == "requirements.txt").select("project", F.lit("python").alias("ecosystem"), F.explode(lines).alias("dependency"))
    keys = lambda p: F.coalesce(F.json_object_keys(F.get_json_object("content", p)), F.array().cast("array<string>"))
    both = F.array_distinct(F.concat(keys("$.dependencies"), keys("$.devDependencies")))
    node = manifests.where(F.col("file_name") == "package.json").select("project", F.lit("node").alias("ecosystem"), F.explode(both).alias("dependency"))
    return py.unionByName(node)


def env_pairs(manifests: DataFrame) -> DataFrame:
    """KEY=VALUE of .env files; the later line wins."""
    rows = F.filter(tx.numbered("content"), lambda x: ~tx.strip(x["line"]).startswith("#") & F.contains(x["line"], F.lit("=")))
    e = manifests.where(F.col("file_name").startswith(".env")).select("project", "file_name", F.explode(rows).alias("r"))
    body = tx.strip(F.col("r.line"))
    value = tx.strip(F.substring(body, F.instr(body, "=") + 1, F.length(body)))
    value = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
    flat = e.select("project", "file_name", F.col("r.n").alias("n"), tx.strip(F.substring_index(body, "=", 1)).alias("key"), value.alias("value"))
    return flat.groupBy("project", "file_name", "key").agg(F.max_by("value", "n").alias("value"))


_ENV_ORDER = [".env", ".env.local", ".env.production", ".env.development"]


def _map(d: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast(kind))]), key)


def detect_port(manifests: DataFrame) -> DataFrame:
    """PORT of the env files in order, then a script's --port or -p, then the type's default."""
    order = F.array_position(F.array(*[F.lit(f) for f in _ENV_ORDER]), F.col("file_name"))
    port = env_pairs(manifests).where((F.col("key") == "PORT") & (order > 0)).select("project", order.alias("o"), F.col("value").try_cast("int").alias("p"))
    env = port.where(F.col("p").isNotNull()).groupBy("project").agg(F.min_by("p", "o").alias("env_port"))
    scripts = []
    for name in ("dev", "start", "serve"):
        text = F.coalesce(F.get_json_object("package_json", f"$.scripts.{name}"), F.lit(""))
        scripts += [F.nullif(F.regexp_extract(text, rx, 1), F.lit("")) for rx in (r"--port\s+(\d+)", r"-p\s+(\d+)")]
    wide = _wide(manifests).select("project", _type().alias("project_type"), F.coalesce(*scripts).cast("int").alias("script_port"))
    default = F.coalesce(_map(DEFAULT_PORTS, F.col("project_type"), "int"), F.lit(3000))
    return wide.join(env, "project", "left").select("project", "project_type", F.coalesce("env_port", "script_port", default).alias("port"))


def base_image(manifests: DataFrame) -> DataFrame:
    t = F.col("project_type")
    plain = F.coalesce(_map(BASE_IMAGES, t, "string"), F.lit("node:20-alpine"))
    bun = F.contains(F.lower(F.coalesce(F.get_json_object("package_json", "$.packageManager"), F.lit(""))), F.lit("bun")) | _has("bun_lock") | _has("bun_lockb")
    rx = r"python\s*=\s*[\"']>=?(\d+)\.(\d+)"
    py = F.coalesce("pyproject_toml", F.lit(""))
    node = F.regexp_extract(F.coalesce(F.get_json_object("package_json", "$.engines.node"), F.lit("")), r"(\d+)", 1)
    image = (F.when(bun, F.coalesce(_map(BASE_IMAGES, F.concat(t, F.lit("-bun")), "string"), plain))
             .when(t.isin("fastapi", "python") & py.rlike(rx), F.concat(F.lit("python:"), F.regexp_extract(py, rx, 1), F.lit("."), F.regexp_extract(py, rx, 2), F.lit("-slim")))
             .when(t.isin("nextjs", "react", "vue", "angular", "express", "nuxt", "node") & (node != ""), F.concat(F.lit("node:"), node, F.lit("-alpine")))
             .otherwise(plain))
    return _wide(manifests).withColumn("project_type", _type()).select("project", "project_type", image.alias("base_image"))


def framework_versions(manifests: DataFrame) -> DataFrame:
    first = lambda c, rx: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rx, 1), F.lit("")), F.lit(UNSTATED))
    deps = [F.when(F.get_json_object("package_json", f"$.dependencies.{d}").isNotNull(), F.concat(F.lit(f"{d}="), F.get_json_object("package_json", f"$.dependencies.{d}")))
            for d in KEY_DEPENDENCIES]
    return _wide(manifests).select(
        "project", F.when(_has("pyproject_toml"), first(F.col("pyproject_toml"), r"python\s*=\s*[\"']([^\"']+)[\"']")).alias("python_version"),
        F.when(_has("package_json"), F.coalesce(F.get_json_object("package_json", "$.engines.node"), F.lit(UNSTATED))).alias("node_version"),
        F.when(_has("package_json"), F.array_join(F.array_compact(F.array(*deps)), ",")).alias("key_dependencies"),
        F.when(_has("go_mod"), first(F.col("go_mod"), r"go\s+([0-9.]+)")).alias("go_version"))


def db_indicators(manifests: DataFrame) -> DataFrame:
    low = F.lower("content")
    names = {"postgres": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "redis": "Redis"}
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), v) for k, v in names.items()]))
    return manifests.where(F.col("file_name") == ".env").select("project", F.explode(found).alias("database"))
