import random
import re

import pyarrow as pa
import pytest

from loomfield.llm import license_scan as ls

def instance(markup, optional=True, said="Jo Doe"):
    """A text that a template accepts: with or without its optional regions, replaceable ones filled."""
    depth, out = 0, []
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", markup):
        depth += {"[[": 1, "]]": -1}.get(part, 0)
        if part not in ("[[", "]]") and (optional or not depth):
            out.append(said if part[0] == "{" else part)
    return " ".join(out)


MIT = instance(ls.TEMPLATES["MIT"])
TEXTS = [
    None, "", "MIT License", "the mit-license; Apache   License and GENERAL public\nlicense. MIT LICENSE", "mitlicense mit, licenses", "é mit license", "x " * 30_000 + "general public license",
    MIT, MIT.replace("merge,", "fuse,"), "released under the terms of the MIT license", "Licensed under the Apache License, Version 2.0 (the License); you may not use any of it except in compliance with the License", "GNU General Public License terms under the GNU Lesser General Public License",
]


def brute(text):
    words = ls.tokens(text or "")
    places = [(i, label) for phrase, label in ls.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_a_plain_search(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, None, None)], "doc_id long, text string, labels string").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in ls.scan(docs).collect())
    want = [((i is None, i or 0), brute(t)) for i, t in [*enumerate(TEXTS), (2, TEXTS[2]), (None, None)]]
    assert [g[1] for g in got] == [w[1] for w in sorted(want, key=lambda x: x[0])]
    assert ls.scan(docs.limit(0)).collect() == []


def labels(*texts):
    return [set(filter(None, x.split(","))) for x in ls.matcher().run(pa.array(texts))[5]]


def matches(words, markup):
    """Whether the words hold an accepted run somewhere: plain backtracking over the markup, apart from the automata."""
    parts = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\[\]{}]+", markup)
    steps = []
    for p in parts:
        steps += [p] if p in ("[[", "]]") or p[0] == "{" else ls.tokens(p)

    def closing(i):
        depth = 0
        for k in range(i, len(steps)):
            depth += {"[[": 1, "]]": -1}.get(steps[k], 0)
            if not depth:
                return k
        raise AssertionError

    todo, seen = [(i, 0) for i in range(len(words))], set()
    while todo:
        at, k = todo.pop()
        if (at, k) in seen:
            continue
        seen.add((at, k))
        if k == len(steps):
            return True
        x = steps[k]
        if x == "[[":
            todo += [(at, k + 1), (at, closing(k) + 1)]
        elif x == "]]":
            todo.append((at, k + 1))
        elif x[0] == "{":
            todo += [(at + n, k + 1) for n in range(int(x[2:-2]) + 1) if at + n <= len(words)]
        elif at < len(words) and words[at] == x:
            todo.append((at + 1, k + 1))
    return False


def variants():
    rng = random.Random(3)
    out = list(TEXTS)
    for markup in ls.TEMPLATES.values():
        for optional in (True, False):
            words = instance(markup, optional).split()
            out.append("so: " + " ".join(words).upper() + " end")
            for _ in range(2):  # a word lost, changed or added
                own, at = list(words), rng.randrange(len(words))
                own[at : at + 1] = rng.choice([[], ["qq"], [own[at], "qq"]])
                out.append(" ".join(own))
    return out


def test_labels_and_scores_match_plain_backtracking():
    texts = variants()
    got = ls.matcher().run(pa.array(texts))
    for text, names, score in zip(texts, got[5], got[6]):
        words = ls.tokens(text or "")
        found = {k for k, m in ls.TEMPLATES.items() if matches(words, m)}
        base = {label for phrase, label in ls.BASE.items() if f" {phrase} " in f" {' '.join(words)} "}
        assert set(filter(None, names.split(","))) == found | base, text
        assert score == (1.0 if found & ls.TEXTS.keys() else 0.75 if found else 0.5 if base else 0.0)


@pytest.mark.parametrize("name", ls.TEMPLATES)
def test_each_template_takes_its_own_text_and_no_other_wording(name):
    full, bare, long = labels(instance(ls.TEMPLATES[name]), instance(ls.TEMPLATES[name], optional=False), instance(ls.TEMPLATES[name], said="x " * 30))
    assert name in full and name in bare
    assert name not in long or "{{" not in ls.TEMPLATES[name]


def test_rows_match_the_sql(spark):
    import duckdb
    import pandas as pd

    texts = variants()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    cursor = con.execute(ls.ORACLE_SQL)
    columns = [d[0] for d in cursor.description]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in ls.scan(docs).select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize(("markup", "text", "end"), [
    ("a b [[c d]] e", "a b e", 3), ("a b [[c d]] e", "a b c d e", 5), ("a b [[c d]] e", "a b c e", -1), ("a {{2}} b", "a b", 2), ("a {{2}} b", "a x y b", 4), ("a {{2}} b", "a x y z b", -1),
    ("a [[b [[c]] d]] e", "a b d e", 4), ("a [[b [[c]] d]] e", "a b c d e f", 5), ("[[a]] [[b]] c", "c", 1), ("a [[b]]", "a b", 2),
])
def test_automata(markup, text, end):
    assert ls.compile_template(markup).longest(text.split(), 0) == end


ISC = """Permission to use, copy, modify, {0} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_both_forms_of_isc_and_no_cut_texts(spark):
    from loomfield.llm import license_scan, license_texts

    postgres = license_texts.TEXTS["PostgreSQL"].split("IN NO EVENT")[0]
    rows = [(1, ISC.format("and")), (2, ISC.format("and/or")), (3, ISC.format("or")), (4, postgres)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == got[2][1] == 1.0 and "isc" in got[1][0].lower() and got[3][1] < 1.0 and got[4][1] < 1.0
