import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwarden.llm import chat
from sparkwarden.llm.queries import HOSTILE

TEXT = st.lists(st.one_of(st.sampled_from(["\\", "#", "<", "/", ":", "\n", "</turn>", "### ", "é"]), st.characters(codec="utf-8")), max_size=20).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "System"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    formatted, mask = chat.format_turns(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_a_very_long_text_is_read_back():
    turns = [("user", "x\\" * 200_000 + "</turn>" * 50_000)]
    assert chat.read_back(chat.format_turns(turns)[0]) == turns


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_conversations(spark):
    rng = random.Random(3)
    rows = list(HOSTILE)
    for c in range(20):
        rows += [(c, t, ["user", "assistant", "system", None][rng.randrange(4)], rng.choice([None, "", "hi", "### x: </turn>"])) for t in range(rng.choice([1, 2, 7, 150]))]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (500, None, "user", "q"), (500, 0, "assistant", "r"), (501, 1, "user", "same"), (501, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.tree: r for r in chat.format_trees(chat.linear_trees(df)).collect()}
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[c].append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), len(got[c].formatted))
    assert chat.format_trees(chat.linear_trees(df.limit(0))).count() == 0


def test_branches_against_recursion(spark):
    rng = random.Random(6)
    rows, best = [], {}
    for tree in range(12):
        n, kids, score = rng.choice([1, 5, 40]), defaultdict(list), {}
        for v in range(n):
            parent = rng.choice([None, *range(v)]) if v else None
            score[v] = float(rng.randrange(4))
            kids[parent].append(v)
            rows.append((tree, v, parent, "user", f"t{v}", score[v]))
        paths, todo = [], [[v] for v in kids[None]]
        while todo:
            p = todo.pop()
            todo += [[*p, k] for k in kids[p[-1]]]
            if not kids[p[-1]]:
                paths.append(p)
        best[tree] = sorted(paths, key=lambda p: (-sum(score[v] for v in p), p[-1]))[:3]
    rows += [(90, 1, 2, "user", "loop", 1.0), (90, 2, 1, "user", "loop", 1.0), (91, 5, 77, "user", "orphan", None), (91, None, 5, "user", "no node", 1.0)]
    best[91] = [[5]]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = defaultdict(dict)
    for r in chat.branches(df, 3).collect():
        got[r.tree].setdefault(r.branch, {})[r.position] = r.node
    assert {t: [[p[k] for k in sorted(p)] for _, p in sorted(b.items())] for t, b in got.items()} == best
    assert chat.format_trees(df, 2).where("tree = 91").count() == 1


def test_a_round_of_a_long_path_reads_as_many_tables_as_the_first(spark, monkeypatch):
    read, write = [], chat.written

    def counted(df, what):
        read.append((what, len(df.inputFiles()), df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")))
        return write(df, what)

    monkeypatch.setattr(chat, "written", counted)
    rows = [(1, k, k - 1 if k else None, "user", "x", 0.0) for k in range(300)] + [(2, 0, None, "user", "y", 0.0)]
    got = chat.branches(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")).collect()
    assert sorted((r.tree, r.position, r.node) for r in got) == [(1, k, k) for k in range(300)] + [(2, 0, 0)]
    rounds = [n for what, _, n in read if what == "tree-jump"][1:]
    assert len(rounds) >= 8 and max(rounds) == rounds[0]
