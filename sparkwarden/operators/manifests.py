"""Package manifests: text in, rows (manifest, ecosystem, name, version_spec, line_num, snippet) out.

Every format is an expression, over the content or over a line with the last heading above it, so that all manifests are
parsed in one pass. Line 0 stands for formats that are read as a whole. Null and unparsable contents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.functions.catalog import DOTNET_PROJECTS, MANIFESTS
from sparkwarden.functions.text import basename, extension, strip

# --- fixed values: formats ---
REQUIREMENT = r"^([a-zA-Z0-9_\-\\.]+)(?:\[[^\]]+\])?\s*([><=!~]+\s*[a-zA-Z0-9_\-\\.\*]+(?:\s*,\s*[><=!~]+\s*[a-zA-Z0-9_\-\\.\*]+)*)"
GRADLE = r"(?:implementation|api|compile|runtimeOnly|testImplementation|testCompile)\s*\(?\s*['\"]([^'\"]+)['\"]\s*\)?"
GEM = r"^gem\s+[\"']([^\"']+)[\"']\s*,\s*[\"']([^\"']+)[\"']"
NUGET = r"(?i)<package\s+id=\"([^\"]+)\"[^>]*version=\"([^\"]+)\""
CSPROJ = r"(?i)<PackageReference\s+Include=\"([^\"]+)\"[^>]*Version=\"([^\"]+)\""
YARN = r"(?m)^\"?(@?[^@\n]+)@[^:\n]+\"?\s*:\s*$\s*version\s+\"([^\"]+)\""
POM = r"<dependency>\s*<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
BUILD_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "target", "bin", "obj", ".gradle")
JSON_SECTIONS = {"package_json": ("dependencies", "devDependencies", "peerDependencies"), "composer": ("require", "require-dev")}


def _group(k: int, pattern: str, c: Column | str = "line") -> Column:
    return F.regexp_extract(c, pattern, k)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), "^\"+|\"+$", ""), "^'+|'+$", "")


def _item(name: Column, spec: Column, snippet: Column, line: Column | int = 0) -> Column:
    number = F.lit(line) if isinstance(line, int) else line
    return F.struct(number.cast("int").alias("line_num"), F.lower(name).alias("name"), spec.alias("version_spec"), snippet.alias("snippet"))


# --- formats that are read as a whole: an array of packages --------------------------------------------------------------


def _every(pattern: str, groups: int, item) -> Column:
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(groups + 1)])
    return F.transform(found, lambda f: item(*[f[f"g{k}"] for k in range(groups + 1)]))


def _json(kind: str) -> Column:
    sections = JSON_SECTIONS[kind]
    parsed = F.from_json("content", f"struct<{', '.join(f'`{x}`:map<string,string>' for x in sections)}>")
    entries = F.flatten(F.array_compact(F.array(*[F.map_entries(parsed.getField(x)) for x in sections])))
    some = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), strip(e["value"]).alias("v"))), lambda e: (e["v"] != "") & ~e["v"].startswith("{") & ~e["v"].startswith("["))
    if kind == "composer":
        some = F.filter(some, lambda e: F.lower(e["k"]) != "php")
    return F.transform(some, lambda e: _item(e["k"], e["v"], F.concat(F.lit('{"'), e["k"], F.lit('": "'), e["v"], F.lit('"}'))))


def _pom() -> Column:
    found = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(POM), F.lit(k)).alias(f"g{k}") for k in range(4)])
    found = F.filter(F.transform(found, lambda f: F.struct(*[strip(f[f"g{k}"]).alias(f"g{k}") for k in range(1, 4)])), lambda f: ~f["g3"].startswith("$"))
    return F.transform(found, lambda f: _item(F.concat_ws(":", f["g1"], f["g2"]), f["g3"], F.concat_ws(":", f["g1"], f["g2"], f["g3"])))


WHOLE = {
    "package_json": lambda: _json("package_json"),
    "composer": lambda: _json("composer"),
    "nuget": lambda: _every(NUGET, 2, lambda whole, name, spec: _item(name, spec, F.substring(whole, 1, 80))),
    "csproj": lambda: _every(CSPROJ, 2, lambda whole, name, spec: _item(name, spec, F.substring(whole, 1, 80))),
    "yarn": lambda: _every(YARN, 2, lambda whole, name, spec: _item(strip(name), spec, F.concat_ws("@", strip(name), spec))),
    "pom": _pom,
}

# --- formats that are read by lines: headings, and what a line under a heading holds -------------------------------------


def _requirements() -> Column:
    line = F.col("line")
    cut = strip(F.split_part(line, F.lit(" #"), F.lit(1)))
    spec = strip(_group(2, REQUIREMENT, cut))
    return F.when(~line.startswith("#") & ~line.startswith("-") & (spec != ""), _item(_group(1, REQUIREMENT, cut), spec, line, F.col("line_num")))


def _pipfile() -> Column:
    line, spec = F.col("line"), _unquoted(_group(1, r"^[^=]*=(.*)$"))
    kept = F.col("section").isin("[packages]", "[dev-packages]") & line.contains("=") & ~line.startswith("#") & ~spec.isin("", "*")
    return F.when(kept, _item(_unquoted(_group(1, r"^([^=]*)=")), spec, line, F.col("line_num")))


def _gradle() -> Column:
    parts = F.split(_group(1, GRADLE), ":")
    part = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(F.size(parts) >= 3, _item(F.concat_ws(":", part(1), part(2)), part(3), F.col("line"), F.col("line_num")))


def _gomod() -> Column:
    line, words = F.col("line"), F.split("line", r"\s+")
    at = F.when(F.col("section") == "require (", 1).when(line.startswith("require "), 2)
    word = lambda k: F.try_element_at(words, at + k)
    return F.when(at.isNotNull() & (F.size(words) > at), _item(word(0), F.regexp_replace(word(1), "^v+", ""), line, F.col("line_num")))


def _cargo() -> Column:
    line, value = F.col("line"), strip(_group(1, r"^[^=]*=(.*)$"))
    spec = F.when(value.startswith("{"), F.regexp_extract(value, r"version\s*=\s*\"([^\"]+)\"", 1)).when(value.rlike("^\".*\"$"), F.regexp_replace(value, "^\"+|\"+$", ""))
    kept = F.col("section").startswith("[dependencies") & line.contains("=") & ~line.startswith("#") & (F.coalesce(spec, F.lit("")) != "")
    return F.when(kept, _item(F.regexp_replace(strip(_group(1, r"^([^=]*)=")), "^\"+|\"+$", ""), spec, line, F.col("line_num")))


def _gemfile() -> Column:
    return F.when(F.col("line").rlike(GEM), _item(_group(1, GEM), _group(2, GEM), F.col("line"), F.col("line_num")))


def _bracketed(line: Column) -> Column:
    return line.startswith("[") & line.endswith("]")


LINED = {"requirements": _requirements, "pipfile": _pipfile, "gradle": _gradle, "gomod": _gomod, "cargo": _cargo, "gemfile": _gemfile}
HEADINGS = {
    "pipfile": _bracketed,
    "gomod": lambda line: (line == "require (") | (line == ")"),
    "cargo": lambda line: line.startswith("[dependencies") | _bracketed(line),
}


def _by_parser(exprs: dict[str, Column]) -> Column:
    out = None
    for kind, e in exprs.items():
        out = F.when(F.col("parser") == kind, e) if out is None else out.when(F.col("parser") == kind, e)
    return out


def parse(m: DataFrame, kinds: tuple[str, ...] = (*WHOLE, *LINED)) -> DataFrame:
    """The packages of (manifest, content, parser, more columns), each row with all columns but the content. One pass over m.

    Every content becomes an array, of packages or of lines, and is exploded once; lines under headings get the last
    heading at or above them by a window over their manifest, which only formats with headings need.
    """
    keep = [c for c in m.columns if c != "content"]
    whole, lined, headed = ([k for k in kinds if k in of] for of in (WHOLE, LINED, HEADINGS))
    lines = F.transform(F.split("content", "\r?\n"), lambda x, k: F.struct((k + 1).alias("line_num"), strip(x).alias("line")))
    arrays = [_by_parser({k: WHOLE[k]() for k in whole}).alias("_whole")] if whole else []
    if not lined:
        return m.select(*keep, *arrays).select(*keep, F.explode("_whole").alias("p")).select(*keep, "p.*")
    # a package of a whole content rides as a line of its own, so that one explode serves both
    none = F.lit(None).cast("struct<line_num:int,name:string,version_spec:string,snippet:string>")
    blank = F.struct(F.lit(None).cast("int").alias("line_num"), F.lit(None).cast("string").alias("line"))
    items = F.when(F.col("parser").isin(*lined), F.transform(lines, lambda x: F.struct(x.alias("at"), none.alias("p"))))
    if whole:
        items = items.otherwise(F.transform(_by_parser({k: WHOLE[k]() for k in whole}), lambda p: F.struct(blank.alias("at"), p.alias("p"))))
    rows = m.select(*keep, F.explode(items).alias("x")).select(*keep, "x.at.line_num", "x.at.line", "x.p")
    if headed:
        heading = _by_parser({k: F.when(HEADINGS[k](F.col("line")), F.col("line")) for k in headed})
        w = Window.partitionBy("manifest", "parser").orderBy("line_num")
        rows = rows.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(w)).where(F.col("heading").isNull())
    found = F.coalesce("p", _by_parser({k: LINED[k]() for k in lined}))
    return rows.select(*keep, found.alias("p")).where(F.col("p").isNotNull()).select(*keep, "p.*")


def _parser(kind: str):
    def run(m: DataFrame) -> DataFrame:
        return parse(m.withColumn("parser", F.lit(kind)), (kind,)).drop("parser")

    return run


PARSERS = {kind: _parser(kind) for kind in (*LINED, *WHOLE)}


def detect(files: DataFrame, path: str = "file_path") -> DataFrame:
    """files with ecosystem and parser: manifests by name at the root, project files by extension anywhere but in build folders."""
    names = F.create_map(*[F.lit(x) for name, (eco, kind) in MANIFESTS.items() for x in (name, f"{eco}|{kind}")])
    root = F.when(~F.col(path).contains("/"), F.try_element_at(names, F.col(path)))
    hidden = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, BUILD_DIRS)))
    dotnet = F.when(extension(F.col(path)).isin(*DOTNET_PROJECTS) & ~hidden, "NuGet|csproj")
    found = files.withColumn("_kind", F.coalesce(root, dotnet)).where(F.col("_kind").isNotNull())
    return found.withColumn("ecosystem", F.split_part("_kind", F.lit("|"), F.lit(1))).withColumn("parser", F.split_part("_kind", F.lit("|"), F.lit(2))).drop("_kind")


def packages(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """All manifests' packages, in one pass over the files. Each is attributed to the manifest that it stands in."""
    found = detect(files, path).select(F.col(path).alias("manifest"), F.col(content).cast("string").alias("content"), "ecosystem", "parser")
    return parse(found).drop("parser")


def bound_version(spec: Column) -> Column:
    """The version that a constraint is tested as: its first clause without operator, wildcards and leading ^ ~ v."""
    first = strip(F.split_part(spec, F.lit(","), F.lit(1)))
    bare = strip(F.regexp_replace(first, r"^[><=!~]+", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"\*+$", ""), r"^[\^~vV]+", "")


__all__ = ["PARSERS", "basename", "bound_version", "detect", "packages"]
