"""Operators over tables against plain versions: rule index, version ranges, dependencies, bursts, verdicts of a stream."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as K
from sparkwarden.functions import text as T
from sparkwarden.operators import advisories, bursts, char_model, code_rules, cube, dependencies, line_ranges, line_sequences, rule_index, version_ranges
from sparkwarden.plans import fixtures as X
from sparkwarden.plans import tables
from sparkwarden.sources import nested_ignore
from sparkwarden.sources.patterns import to_regex
from sparkwarden.streaming import verdicts

# --- rule index ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(1)
    code = [t for _, t in X.CODE] + [t for _, t in X.SECRET_LINES]
    rows = [(k, t) for k, t in enumerate(code)] + [(1000 + k, rng.choice(["é " * 5, "", "x" * 300, "aaa" * 50]) + rng.choice(code) + rng.choice([" ñ", "", rng.choice(code)])) for k in range(600)]
    rows += [(5000, None), (5001, ""), (5002, "ev"), (5003, "eval(" * 4000), (1, code[1])]
    return spark.createDataFrame(rows, "id long, line string").withColumn("line_no", F.lit(1)).withColumn("gram", F.lit("clash"))


def test_rule_index_finds_what_the_rules_find(spark, lines):
    every = sorted(tuple(r) for r in code_rules.code_findings(lines, "id").select("id", "line_no", "rule_id", "severity", "confidence").collect())
    every += [tuple(r) for r in code_rules.secret_findings(lines, "id").select("id", "line_no", "rule_id", "severity", "confidence").collect()]
    rarest = {g: rng for g, rng in zip(sorted({g for *_, x in rule_index._literals(tables.RULES) for g in rule_index._grams(x)}), iter(lambda: random.Random(0).random(), 2), strict=False)}
    for counts in (None, {}, rarest):
        got = rule_index.indexed_findings(lines, tables.RULES, "id", silent=tables._silent(), counts=counts)
        assert sorted(tuple(r) for r in got.select("id", "line_no", "rule_id", "severity", "confidence").collect()) == sorted(every)
    assert rule_index.indexed_findings(lines, [], "id").count() == 0 == rule_index.indexed_findings(lines.limit(0), tables.RULES, "id").count()


def _joined_on(df):
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]


def test_rule_index_of_words_looks_at_few_bytes_first(spark):
    texts = ["x" * 3000 + "abcdefgh" * 3, "abcdefg abcdefgh", "İabcdefgh ΑΣabcdefgh", "éa édgh", "ÉDGH ab", "abcdefgH", "(a+b) abcdefgh", ""]
    lines = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "id long, line_no int, line string")
    rules = [("W", "LOW", 0.5, ("abcdefgh",), "(?i)abcdefgh"), ("N", "LOW", 0.5, ("édgh",), "(?i)édgh"), ("C", "LOW", 0.5, ("abcdefgH", "(a+b)"), r"abcdefgH|\(a\+b\)")]
    for counts in (None, {}, {b"abc": 9, b"dgh": 1, b"fgh": 1}):
        got = rule_index.indexed_findings(lines, rules, "id", counts=counts)
        assert sorted((r.id, r.rule_id) for r in got.collect()) == [(0, "W"), (1, "W"), (2, "W"), (3, "N"), (4, "N"), (5, "C"), (5, "W"), (6, "C"), (6, "W")]
    (join,) = _joined_on(got)
    assert "lambda" not in join and "regexp" not in join  # patterns are tried in the order of rules, and the join is compiled


def test_rule_index_of_all_rules_joins_without_functions_of_arrays(spark, lines):
    (join,) = _joined_on(rule_index.indexed_findings(lines, tables.RULES, "id", silent=tables._silent(), counts={}))
    assert "lambda" not in join and "rlike" not in join.lower() and "regexp" not in join


def test_rule_index_reads_lines_once_and_makes_no_row_for_a_byte(spark, monkeypatch):
    texts = ["a=", "=b", "==", "x == y", "", "=", "é", "é==", "K==AC", "ac", "AC", "xA", "C", "K", "k", None, "a==" * 9, "evaL", "va eval"]
    lines = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "id long, line_no int, line string").coalesce(1)
    rules = [("E", "LOW", 0.5, ("==",), "=="), ("A", "LOW", 0.5, ("AC",), "AC"), ("K", "LOW", 0.5, ("k",), "(?i)k"), ("V", "LOW", 0.5, ("eval", "=="), "eval|y|==")]
    want = sorted((k, r) for k, t in enumerate(texts) for r, _, _, _, p in rules if t and re.search(p, t))
    for most in (rule_index.WORK_BYTES, 3, 1):
        monkeypatch.setattr(rule_index, "WORK_BYTES", most)
        got = rule_index.indexed_findings(lines, rules, "id")
        assert sorted((r.id, r.rule_id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "sequence(" not in plan


def test_rule_index_in_blocks_and_odd_literals(spark, lines, monkeypatch):
    rules = [("A", "LOW", 1.0, ("ev",), r"ev"), ("B", "LOW", 1, ("é ",), r"é é"), ("C", "HIGH", 0.5, ("EVAL", "aaa"), r"(?i)eval|a{150}"), ("D", "LOW", 1.0, (), r"^x{300}"), ("E", "LOW", 1.0, ("eval(", "exec(", "zzz"), r"e(val|xec)\("), ("F", "LOW", 1.0, ("AAA",), r"AAA")]
    want = sorted((r.id, rule) for r in lines.collect() for rule, _, _, literals, pattern in rules if r.line and re.search(pattern, r.line))
    for rows in (50_000, 2, 1):
        monkeypatch.setattr(rule_index, "BLOCK_ROWS", rows)
        assert sorted((r.id, r.rule_id) for r in rule_index.indexed_findings(lines, rules, "id").collect()) == want


# --- version ranges -----------------------------------------------------------------------------------------------------------------

SPELLED = ["1.0", "1", "1.0.0", "1.0a1", "1.0.dev3", "1.0.post2", "1.0rc1.dev2", "1!0.5", "2.10", "2.9", "02.009", "1.0+local", "99999999999999999999.1", "99999999999999999998", "1" * 100, "1." + "2" * 95, "junk", "", "1.0.post1.dev1", "1.5", "1.0b2.post1", "3.0.1", "3.1"]
CLAUSES = ["<1.0", "<=1.0", ">1.0", ">=1.0", "==1.0", "==1.*", "==1.0.*", "!=1.0", "!=1.0.*", "~=1.0", "~=2.9.0", ">1.0a1", "<1.0rc1", ">=1.0.dev1,<2", "> 1.0.post1", "==junk", ">=1,==x", "", "===1.0", ">=99999999999999999998.5", "<" + "1" * 99, "~=3.0", ">=0,!=2.9,<99", "<1!0"]


def test_range_hits_are_those_of_a_nested_loop(spark):
    points = spark.createDataFrame([(p, v) for p in ("a", "b", None) for v in SPELLED + [None]] * 2, "package string, version string").withColumn("key", F.lit(1))
    ranges = spark.createDataFrame([(100 * n + k, p, c) for n, p in enumerate(("a", "b", "c")) for k, c in enumerate([*CLAUSES, None]) if p != "b" or k % 2], "range_id long, package string, clauses string")
    pairs = points.select("package", "version").distinct().join(ranges, "package").where("clauses is not null")
    want = pairs.where(advisories.affected(F.col("version"), F.array("clauses"))).select("package", "version", "range_id")
    got = version_ranges.range_hits(points, ranges)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 150
    assert version_ranges.range_hits(points.limit(0), ranges).count() == version_ranges.range_hits(points, ranges.limit(0)).count() == 0


def test_keys_sort_as_versions_do(spark):
    from packaging.version import InvalidVersion, Version

    rows = spark.createDataFrame([(v,) for v in SPELLED], "v string").select("v", version_ranges.order_key(advisories.version_key(F.col("v"))).alias("k"), advisories.version_key(F.col("v")).alias("s")).collect()
    known = []
    for r in rows:
        try:
            known.append((Version(r.v.split("+")[0]), r))
        except InvalidVersion:
            assert r.k is None
    for a, x in known:
        for b, y in known:
            assert (a < b, a == b) == (x.k < y.k, x.k == y.k) == (tuple(x.s) < tuple(y.s), x.s == y.s)


# --- dependencies ---------------------------------------------------------------------------------------------------------------------


def test_closure_is_breadth_first_with_the_nearest_winning(spark):
    rng = random.Random(2)
    edges = [(f"p{rng.randrange(40)}", f"p{rng.randrange(40)}", f"{rng.randrange(3)}.0") for _ in range(60)] + [("p1", "p1", "1.0"), ("p2", "p3", "0.1"), ("p3", "p2", "0.2"), (None, "p1", "1"), ("p1", None, "1")]
    roots = [(r, f"p{rng.randrange(40)}", "9") for r in ("x", "y", "z", None) for _ in range(3)] + [("x", None, "1")]
    needs = {}
    for a, b, v in edges:
        if a and b:
            needs.setdefault(a, {}).setdefault(b, set()).add(v)
    for most in (None, 0, 2):
        want = {}
        for r in {r for r, _, _ in roots}:
            front = {p: (None, "9") for q, p, _ in roots if q == r and p}
            depth = 0
            while front:
                want |= {(r, p): (depth, *by) for p, by in front.items()}
                if depth == most:
                    break
                depth += 1
                after = {}
                for p in front:
                    for q, versions in needs.get(p, {}).items():
                        if (r, q) not in want:
                            after[q] = min(after.get(q, (p, min(versions))), (p, min(versions)))
                front = after
        got = dependencies.closure(spark.createDataFrame(roots * 2, "root string, package string, version string"), spark.createDataFrame(edges, "package string, needs string, version string"), most)
        rows = got.collect()
        assert {(r.root, r.package): (r.depth, r.parent, r.version) for r in rows} == want and len(rows) == len(want)


def test_requirements_get_the_best_version(spark):
    asked = spark.createDataFrame([("a", "x", ">=1,<2"), ("b", "x", ">=1,<2"), ("a", "y", ">9"), ("a", "x", "~=2.0"), ("a", "z", ">0")], "package string, needs string, clauses string")
    offered = spark.createDataFrame([("x", "1.10"), ("x", "1.9"), ("x", "2.0"), ("x", "2.0.0"), ("x", "2.5"), ("y", "1"), ("x", "junk")], "package string, version string")
    assert sorted(tuple(r) for r in dependencies.resolved(asked, offered).collect()) == [("a", "x", ">=1,<2", "1.10"), ("a", "x", "~=2.0", "2.5"), ("b", "x", ">=1,<2", "1.10")]
    assert dependencies.resolved(asked.limit(0), offered).count() == 0


# --- bursts ----------------------------------------------------------------------------------------------------------------------------


def plain_bursts(events, within, least):
    out = []
    by = {}
    for u, t in events:
        if t is not None:
            by.setdefault(u, []).append(t)
    for u, times in by.items():
        times.sort()
        covered, j = [], 0
        for i, t in enumerate(times):
            j = max(j, i)
            while j + 1 < len(times) and times[j + 1] - t <= within:
                j += 1
            if j - i + 1 >= least:
                covered.append((t, times[j]))
        spans = []
        for s, e in covered:
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        out += [(u, s, e, sum(s <= t <= e for t in times)) for s, e in spans]
    return out


@pytest.mark.parametrize(("within", "least"), [(5, 3), (1, 2), (20, 6), (0, 2), (3, 1)])
def test_bursts_are_those_of_two_pointers(spark, within, least):
    rng = random.Random(within)
    base = datetime.datetime(2024, 1, 1)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(-200, 600) // rng.choice([1, 5])) for _ in range(500)] + [(9, 8 * within * k) for k in range(5)] + [(8, k) for k in range(0, 300, 4)] + [(1, None)]
    rows = [(u, None if t is None else base + datetime.timedelta(seconds=t)) for u, t in events]
    got = bursts.any_window_bursts(spark.createDataFrame(rows, "user_id long, ts timestamp").withColumn("t", F.lit(0)), within, least).collect() if within else []
    if not within:
        return
    want = [(u, base + datetime.timedelta(seconds=s), base + datetime.timedelta(seconds=e), n) for u, s, e, n in plain_bursts(events, within, least)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


# --- verdicts of a stream ------------------------------------------------------------------------------------------------------------------


def _stream(spark, rows, path, files):
    cut = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], "source string, ts timestamp, severity string").coalesce(1).write.parquet(f"{path}/in/part={k}")
    return spark.readStream.schema("source string, ts timestamp, severity string, part int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_a_stream_in_any_order_ends_with_the_batchs_verdicts(spark, tmp_path):
    rng = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", "c", None]), base + datetime.timedelta(minutes=rng.randrange(600)), rng.choice(["LOW"] * 8 + ["low", "MEDIUM", None, "odd"])) for _ in range(60)] + [("d", base, None), ("b", base, "HIGH"), ("a", None, "CRITICAL")]
    rng.shuffle(rows)
    stream = verdicts.running_verdicts(_stream(spark, rows, str(tmp_path), 4), "source", "ts", late="2 days")
    out = verdicts.run_to_end(stream, f"file://{tmp_path}", "verdicts").collect()
    ranks = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
    last = {}
    for r in sorted(out, key=lambda r: r.batch_id):
        assert not r.forgotten and (r.source not in last or r.verdict != last[r.source])
        last[r.source] = r.verdict
    want = {}
    for s, t, severity in rows:
        if t is not None:
            want[s] = max(want.get(s, -1), ranks.get((severity or "").upper(), -1))
    assert last == {s: "BLOCK" if n >= 1 else "WARN" if n == 0 else "PASS" for s, n in want.items()}


def test_late_rows_and_quiet_keys(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    day = lambda n: base + datetime.timedelta(days=n)
    # one file a batch, in this order; after day 20 the watermark is at day 19
    rows = [("a", day(0), "LOW"), ("b", day(20), "LOW"), ("b", day(21), "LOW"), ("a", day(1), "HIGH"), ("c", day(60), "LOW"), ("c", day(61), "LOW"), ("a", day(62), "HIGH")]
    stream = verdicts.running_verdicts(_stream(spark, rows, str(tmp_path), len(rows)), "source", "ts", quiet="5 days", late="1 day")
    out = sorted(verdicts.run_to_end(stream, f"file://{tmp_path}", "verdicts").collect(), key=lambda r: (r.batch_id, r.source))
    seen = [(r.source, r.verdict, r.findings, r.forgotten) for r in out]
    assert seen[0] == ("a", "WARN", 1, False) and ("a", "WARN", 1, True) in seen and ("b", "WARN", 2, True) in seen
    assert [x for x in seen if x[0] == "a"] == [("a", "WARN", 1, False), ("a", "WARN", 1, True), ("a", "BLOCK", 1, False)], "the row of day 1 comes too late, that of day 62 begins anew"


# --- nested ignore rules ---------------------------------------------------------------------------------------------------------------------


def test_the_deepest_last_rule_decides(spark):
    rng = random.Random(5)
    names = ["a", "b", "src", "x.py", "y.log", "build", "[q]", "é.txt"]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["", "a"]
    patterns = ["*.log", "!y.log", "build/", "/x.py", "src/*.py", "**/b/*", "# no", "", "!*", "a", "!a/", "[!a]", "x.??", "\\[q\\]"]
    folders = ["", "a", "src", "a/b", "src/a", "a/b/src", "build", "none"]
    rules = [(f, k, rng.choice(patterns)) for f in folders for k in range(rng.randint(1, 6))] + [(None, 50, "é*")]
    want = {}
    for p in set(paths):
        parts, said = p.split("/"), (False, None, None)
        for d in range(len(parts)):
            folder, rest = "/".join(parts[:d]), "/".join(parts[d:])
            for f, k, pattern in sorted(rules, key=lambda r: r[1]):
                rule = to_regex(pattern)
                if (f or "") == folder and rule and re.search(rule[0], rest):
                    said = (rule[1], folder, pattern)
        want[p] = said
    df = spark.createDataFrame([(p,) for p in paths * 2] + [(None,)], "path string").withColumn("folder", F.lit("clash"))
    table = spark.createDataFrame(rules, "folder string, ord int, pattern string")
    got = nested_ignore.decided(df, table).collect()
    assert {r.path: (r.ignored, r.folder, r.pattern) for r in got} == want and len(got) == len(want)
    assert not any(r.ignored for r in nested_ignore.decided(df, table.limit(0)).collect()) and nested_ignore.decided(df.limit(0), table).count() == 0
    files = spark.createDataFrame([(".gitignore", "*.log\r\n!y.log"), ("a/b/.gitignore", "x"), ("a/x.gitignore", "no")], "file_path string, content string")
    assert sorted(tuple(r) for r in nested_ignore.rules_of_files(files).collect()) == [("", 0, "*.log"), ("", 1, "!y.log"), ("a/b", 0, "x")]


# --- cube ------------------------------------------------------------------------------------------------------------------------------------


def test_cube_merges_deliveries(spark, tmp_path):
    rng = random.Random(6)
    rows = [(d, rng.choice(["x", "y", None]), rng.choice(["p", "q"]), rng.randrange(3000) if rng.random() < 0.95 else None, rng.randrange(10_000) if rng.random() < 0.95 else None) for d in range(6) for _ in range(3000)]
    df = spark.createDataFrame(rows, "day int, a string, b string, who long, size long")
    for d in range(6):  # a delivery at a time
        cube.deliveries(df.where(F.col("day") == d), "day", ["a", "b"], "who", "size").write.mode("append").parquet(f"file://{tmp_path}/days")
    got = {(r.level, r.a, r.b): r for r in cube.cube(spark.read.parquet(f"file://{tmp_path}/days"), ["a", "b"], (0.1, 0.5, 0.9)).collect()}
    assert len(got) == 6 + 3 + 2 + 1
    for (level, a, b), r in got.items():
        mine = [x for x in rows if (level & 2 or x[1] == a) and (level & 1 or x[2] == b)]
        values, sizes = {x[3] for x in mine} - {None}, sorted(x[4] for x in mine if x[4] is not None)
        assert r.n == len(mine) and abs(r.distinct_values - len(values)) <= 0.05 * len(values)
        for share, q in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(sum(x <= q for x in sizes) / len(sizes) - share) <= 0.02
    nothing = cube.deliveries(df.where("a = 'x'").withColumn("size", F.lit(None).cast("long")), "day", ["a"], "who", "size")
    assert all(r.quantiles is None for r in cube.cube(nothing, ["a"]).collect())
    assert cube.cube(cube.deliveries(df.limit(0), "day", ["a"], "who", "size"), ["a"]).where("level = 0").count() == 0


# --- rules over several lines ------------------------------------------------------------------------------------------------------------------


def plain_sequences(lines, steps):
    """(first, last line) by trying, from each line, the nearest line of the next step that can be carried through."""
    numbers = sorted(lines)
    has = lambda n, p: any(re.search(p, x) for x in lines[n] if x is not None)

    def end(n, k):
        if not has(n, steps[k].pattern):
            return None
        if k == len(steps) - 1:
            return n
        step = steps[k + 1]
        for m in (m for m in numbers if n < m <= n + step.within):
            if (last := end(m, k + 1)) is not None:
                return last
            if step.unless and has(m, step.unless):
                return None
        return None

    return [(n, e) for n in numbers if (e := end(n, 0)) is not None]


def test_sequences_are_those_of_a_plain_matcher(spark):
    rng = random.Random(12)
    texts = {(k, s): {n: [rng.choice(["open(f", "write(f)", "close(f)", "x", "open( write(", "a/b", None]) for _ in range(rng.choice([1, 1, 1, 2]))] for n in range(1, rng.randrange(2, 40)) if rng.random() < 0.9} for k in range(40) for s in "ab"}
    texts[None, "a"] = {1: ["open(f"], 2: ["write(f)"]}
    rules = {"R1": r"/open\(/ then within 5 /write\(/ unless /close\(/", "R2": r"/write/ then within 2 /write/ then within 2 /close/", "R3": r"/open/ then within 1 /open/ unless /x/ then within 9 /a\/b/ unless /write/", "R4": "/x/ then within 3 /nowhere/"}
    rows = [(k, s, n, x) for (k, s), t in texts.items() for n, xs in t.items() for x in xs]
    df = spark.createDataFrame(rows, "k int, s string, line_no int, line string").withColumn("met", F.lit("clash"))
    want = sorted(str((k, s, r, n, e)) for (k, s), t in texts.items() for r, text in rules.items() for n, e in plain_sequences(t, line_sequences.parse(text)))
    got = line_sequences.sequence_findings(df, rules, "k", "s")
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(want) > 100
    assert line_sequences.sequence_findings(df.limit(0), rules, "k", "s").count() == 0
    for wrong in ("open", "/a/", "/a/ then /b/", "/a/ then within x /b/", "/a/ then within 2 /b/ or"):
        with pytest.raises(ValueError):
            line_sequences.parse(wrong)


def test_patterns_of_sequences_are_tried_in_one_pass_for_all_rules(spark):
    tried = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            tried.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, n, "open write close"[n % 3 * 5 :][:5]) for n in range(60)], "k int, line_no int, line string").mapInArrow(seen, "k int, line_no int, line string")
    rules = {f"R{n}": f"/open/ then within {n} /write/" for n in range(1, 6)}
    assert line_sequences.sequence_findings(df, rules, "k").count() and tried.value == 60


def test_literal_patterns_of_sequences_are_those_of_the_expressions(spark):
    plain, other = ["a", "[.]", "of|de", "[(]x|é", "a b", "[|]" "c", "😀"], ["a|", "|a", "[^]a]", "a.", "[ab]", "a\\.", "^a", "a$", "(a)", "a{2}", "[&]", "a||b"]
    assert [bool(line_sequences._PLAIN.fullmatch(p)) for p in plain + other] == [p != "[|]c" for p in plain] + [False] * len(other)
    lines = spark.createDataFrame([(x,) for x in ["", "a", ".", "of", "xde", "(x", "(é", "a b", "|c", "😀", "b", None, "ab", "A"]], "line string")
    both = lines.select("line", *[F.array(line_sequences._met(p), F.col("line").rlike(f"(?dU){p}")).alias(str(k)) for k, p in enumerate(plain)])
    assert all(x == y for r in both.collect() for x, y in r[1:])


# --- lines of ranges, randomness -----------------------------------------------------------------------------------------------------------------


def test_lines_of_ranges_are_those_of_whole_texts(spark):
    rng = random.Random(13)
    texts = ["", "a", "\n", "\r\n", "a\r\nb", "\r\r\n\n\r", "x" * 50, "a\n\nb\n"] + ["".join(rng.choice(["a", "é", "\n", "\r", "\r\n", " ", "word "]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (None, "a\nb"), (9999, None)], "k long, t string").withColumn("o", F.lit(0))
    want = {}
    for r in T.lines(df, "k", "t").collect():
        want[r.k, r.line_no] = len(r.line)
    for size in (1, 2, 7, 1000):
        parts = line_ranges.ranges(df, "k", "t", size, "o").repartition(5)
        got = line_ranges.range_lines(parts, "k", "o", "part").collect()
        assert {(r.k, r.line_no): r.n_chars for r in got} == want and len(got) == len(want), size
        assert max(r.pieces for r in got) > 1 or size == 1000
    assert line_ranges.range_lines(line_ranges.ranges(df.limit(0), "k", "t", 5, "o"), "k", "o", "part").count() == 0


def test_equal_ranges_at_one_place_count_each(spark):
    df = spark.createDataFrame([(1, 0, "a\nb"), (1, 0, "a\nb"), (1, 1, "c")], "k long, part int, chunk string")
    assert sorted((r.line_no, r.n_chars) for r in line_ranges.range_lines(df, "k", "part").collect()) == [(1, 1), (2, 2), (3, 2)]


def test_the_character_model_tells_keys_from_words(spark):
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    costs = char_model.model(docs)
    words = [w for r in docs.limit(150).collect() for w in re.findall(r"[A-Za-z]{4,}", r.text)]
    plain = ["".join(rng.choice(words).capitalize() for _ in range(rng.randrange(3, 6))) for _ in range(400)]
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(20, 41))) for _ in range(400)]
    tokens = spark.createDataFrame([(t, k) for ts, k in ((plain, 0), (keys, 1)) for t in ts] + [("a", 0), ("", 0), (None, 0)], "t string, k int")
    rows = tokens.select("t", "k", char_model.bits(F.col("t"), costs).alias("bits"), T.entropy(F.col("t")).alias("entropy")).collect()
    told = [r for r in rows if r.t and len(r.t) > 1]
    sym = lambda c: ord(c) - 32 if 32 <= ord(c) < 127 else 95
    for r in told[:50]:
        assert abs(r.bits - sum(costs[sym(a), sym(b)] for a, b in zip(r.t, r.t[1:], strict=False)) / (len(r.t) - 1)) < 1e-6
    assert {r.bits for r in rows if r.t in ("a", "")} == {0.0} and [r.bits for r in rows if r.t is None] == [None]

    def best(value):
        """Precision and recall at the threshold of the best F1."""
        out = (0, 0, 0)
        for cut in sorted({value(r) for r in told}):
            hit = [r.k for r in told if value(r) >= cut]
            p, c = sum(hit) / len(hit), sum(hit) / len(keys)
            out = max(out, (2 * p * c / (p + c) if p + c else 0, p, c))
        return out

    model_f, p, c = best(lambda r: r.bits)
    assert p > 0.99 and c > 0.99 and model_f > best(lambda r: r.entropy)[0] + 0.1
