"""The markup tokenizer against a plain one that goes character by character."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import html

SPACE = "\t\n\x0c\r "


def attributes(text):
    out, k = {}, 0
    while k < len(text):
        if text[k] in SPACE + "/>=\"'":
            k += 1
            continue
        start = k
        k += 1
        while k < len(text) and text[k] not in SPACE + "/>=":
            k += 1
        name, value, j = text[start:k].lower(), "", k
        while j < len(text) and text[j] in SPACE:
            j += 1
        if j < len(text) and text[j] == "=":
            j += 1
            while j < len(text) and text[j] in SPACE:
                j += 1
            k = j
            if j < len(text) and text[j] in "\"'" and text.find(text[j], j + 1) >= 0:
                k = text.find(text[j], j + 1) + 1
                value = text[j + 1 : k - 1]
            elif j < len(text) and text[j] not in ">\"'":
                while k < len(text) and text[k] not in SPACE + ">":
                    k += 1
                value = text[j:k]
        out.setdefault(name, value)
    return list(out.items())


def tag_end(text, k):
    """Where the tag ends whose name ends at k: after the first > that is in no quoted value; and whether there is one."""
    while k < len(text) and text[k] != ">":
        if text[k] == "=":
            k += 1
            while k < len(text) and text[k] in SPACE:
                k += 1
            if k < len(text) and text[k] in "\"'" and text.find(text[k], k + 1) >= 0:
                k = text.find(text[k], k + 1) + 1
        else:
            k += 1
    return min(k + 1, len(text)), k < len(text)


def plain(text):
    """(kind, name, attributes, body) of a page's markup."""
    out, k = [], 0
    while (k := text.find("<", k)) >= 0:
        after = text[k + 1 : k + 2]
        if text.startswith("<!--", k):
            if text.startswith(">", k + 4) or text.startswith("->", k + 4):
                out.append(("comment", None, [], ""))
                k = text.index(">", k) + 1
                continue
            ends = [(p, len(e)) for e in ("-->", "--!>") if (p := text.find(e, k + 4)) >= 0]
            stop, size = min(ends, default=(len(text), 0))
            out.append(("comment", None, [], text[k + 4 : stop]))
            k = stop + size
        elif after.isascii() and after.isalpha() or (after == "/" and text[k + 2 : k + 3].isascii() and text[k + 2 : k + 3].isalpha()):
            start = k + (2 if after == "/" else 1)
            n = start
            while n < len(text) and text[n] not in SPACE + "/>":
                n += 1
            name = text[start:n].lower()
            end, closed = tag_end(text, n)
            kind = "cut" if not closed else "end" if after == "/" else "start"
            body = None
            found = attributes(text[n : end - 1]) if kind == "start" else []
            if kind == "start" and name in html.RAW:
                stop, low = end, text.lower()
                while True:
                    stop = low.find(f"</{name}", stop)
                    if stop < 0 or low[stop + len(name) + 2 : stop + len(name) + 3] in ("", ">", *SPACE, "/"):
                        break
                    stop += 1
                if stop >= 0 and low[stop + len(name) + 2 : stop + len(name) + 3] == "":
                    # an end tag that the text ends in, without anything after its name
                    body, end = text[end:], len(text)
                    if low.endswith(f"</{name}"):
                        body = body[: -len(name) - 2]
                elif stop >= 0:
                    body = text[end:stop]
                    close = text.find(">", stop)
                    end = close + 1 if close >= 0 else len(text)
                else:
                    body, end = text[end:], len(text)
            out.append((kind, name, found, body))
            k = end
        elif after and after in "!?/":
            stop = text.find(">", k)
            out.append(("declaration", None, [], None))
            k = stop + 1 if stop >= 0 else len(text)
        else:
            k += 1
    return out


PIECES = [
    "<a", "<A HREF=", "<script>", "</script>", "</SCRIPT >", "<script src=x>", "<style>", "</style>", "<!--", "-->", "--!>", "<!-->", "<!DOCTYPE html>", "<?xml", "</>", "</p", "<br/>", "<p class=\"a > b\">",
    " x=1", " y = 'q>r'", " z=\"", "'", "\"", ">", "<", "text", "\n", " ", "/", "=", "é", "<textarea>", "</textarea>", "<i a=1 A=2 b>", "</scripty>", "<title>t</title>", "onclick=go()", "<5",
]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    odd = ["", "no markup", "<script>un", "<div " + 'a="1" ' * 3000 + ">", "<" * 500, "<!--" + "x" * 20_000, "<p " + "'" * 5000 + ">", "<a b=\"" + "<i>" * 3000, "<script>" + "</scrip" * 2000, "a<!-- <b> --><c d=e>"]
    return odd + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def test_tokens_are_those_of_a_plain_tokenizer(spark, pages):
    df = spark.createDataFrame([*enumerate(pages), (-1, None)], "k long, page string").withColumn("raw", F.lit("extra")).repartition(4)
    got = {}
    for r in html.tokens(df, "k", "page").orderBy("k", "ord").collect():
        got.setdefault(r.k, []).append((r.ord, r.kind, r.name, [(a["name"], a["value"]) for a in r.attributes], r.body))
    for k, page in enumerate(pages):
        found = [(n + 1, *t) for n, t in enumerate(plain(page))]
        mine = [(o, kd, nm, at, bd) for o, kd, nm, at, bd in got.get(k, [])]
        assert [x[:4] for x in mine] == [x[:4] for x in found], page
        for a, b in zip(mine, found, strict=True):
            assert a[4] == b[4] or (b[1] == "start" and b[2] in html.RAW and "</" in (b[4] or "") + (a[4] or "")) or b[1] == "cut", (page, a, b)
    assert -1 not in got


def test_checks(spark):
    page = """<!-- <script src="//a.x/1.js"></script> --><script src="//c.x/1.js"></script><SCRIPT SRC='https://b.x/2.js' integrity="sha384-x"></SCRIPT><script src=/own.js></script>
    <script src=http://d.x/z></script><script src="//c.x/1.js"></script><script> go() </script><script> </script><a href=" JavaScript:x()" onClick="y(1)">t</a><textarea><form><input></textarea>
    <form method=POST action="/in"><input type=password><input type=HIDDEN><form><select></select></form><input><form><button></form>"""
    df = spark.createDataFrame([(1, page), (2, "<p>"), (3, None)], "k long, page string")
    found = html.tokens(df, "k", "page")
    assert [tuple(r) for r in html.missing_integrity(found, "k").collect()] == [(1, 3, "c.x/1.js, d.x/z")]
    assert [tuple(r) for r in html.missing_integrity(found, "k", most=1).collect()] == [(1, 3, "c.x/1.js")]
    assert sorted((r.what, r.at, r.chars) for r in html.inline_code(found, "k").collect()) == [("address", "href", 15), ("handler", "onclick", 4), ("script", "", 6)]
    assert sorted((r.method, r.action, r.fields, r.passwords, r.hidden) for r in html.forms(found, "k").collect()) == [("get", "", 1, 0, 0), ("post", "/in", 3, 1, 1)]
    none = html.tokens(df.limit(0), "k", "page")
    assert html.missing_integrity(none, "k").count() == html.inline_code(none, "k").count() == html.forms(none, "k").count() == 0
