"""Line dedup takes repeated passages from their first line to their last."""

from __future__ import annotations

import numpy as np

from textorium.llm import line_dedup

from .test_operators import prose, table


def test_whole_passages(spark):
    passage = prose(700, 40, 7).split("\n")
    rows, want = [(0, "\n".join(passage), "en", "s")], ["\n".join(passage)]
    for k, (a, b) in enumerate([(a, b) for a in range(7) for b in range(a + 2, 9)]):
        head, tail = prose(710 + k, 20, 2), prose(810 + k, 20, k % 3)
        rows.append((k + 1, "\n".join([head, *passage[a:b], tail]), "en", "s"))
        want.append(f"{head}\n{tail}")
    n = len(rows)
    rows += [(n, f"{passage[3]}\nown {n}", "en", "s"), (n + 1, "x y\n\nz\n", "en", "s"), (n + 2, "q\nx y\n\nz", "en", "s"), (n + 3, "a\na\na", "en", "s"), (n + 4, None, "en", "s"), (n + 5, "", "en", "s")]
    want += [rows[n][1], "x y\n\nz\n", "q", "a", None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup(table(spark, rows + rows[3:5]), whole=True).collect()}
    assert [got[k].text for k in range(len(want))] == want
    assert got[1]._n_removed == 2 and got[n + 3]._n_removed == 2


def test_whole_passages_brute_force(spark):
    g = np.random.default_rng(3)
    rows = [(k, "\n".join(str(g.choice(["a", "b", "c", "d", "e", "f", "", " "])) for _ in range(g.integers(1, 12))), "en", "s") for k in range(60)]
    seen, want = set(), {}
    for k, t, *_ in rows:
        lines, gone = t.split("\n"), set()
        w = [i for i, x in enumerate(lines) if x.strip()]
        for i, j in zip(w, w[1:]):
            pair = tuple(lines[i : j + 1])
            if pair in seen:
                gone |= set(range(i, j + 1))
            seen.add(pair)
        want[k] = [x for i, x in enumerate(lines) if i not in gone and x.strip()]
    got = line_dedup.dedup(table(spark, rows), whole=True).collect()
    assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in got} == want
