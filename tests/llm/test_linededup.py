import hashlib
from collections import defaultdict

import pytest

from geoloom.llm import linededup

WHITE = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(WHITE).translate(UPPER)


def brute(rows, chars=20, docs=3):
    holders = defaultdict(set)
    low = float("-inf")
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(low if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == (low if i is None else i)]
        whole = "\n".join(kept)
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256(whole.encode()).hexdigest(), whole))
    return sorted(out, key=str)


def found(docs, **options):
    rows = linededup.drop_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept) for r in rows), key=str)


A, B, C = "A line of twenty signs", "\tÄnother line with an ä in it ", "x" * 19


@pytest.mark.parametrize("batches", [1, 6])
def test_equals_brute_force(make_docs, batches):
    rows = [(i, f"{A}\n{C}\nnumber {i}\n{A.lower()} ") for i in range(0, 40, 3)]
    rows += [(i, f"{B}\n\n{B}\r\n{'only in two documents ' + str(i // 2)}") for i in range(100, 108)]
    rows += [(7, A.upper()), (7, f"other text\n{B}"), (7, A.upper()), (None, A), (None, None), (300, ""), (301, "\n\n"), (302, "ÄNOTHER line with an ä in it")]
    assert found(make_docs(rows).repartition(5), batches=batches) == brute(rows)


def test_hot_line_and_repeated_id(make_docs, monkeypatch):
    """A line in every document, and an id with a third of all rows."""
    monkeypatch.setattr(linededup, "HOT", 40)
    rows = [(k, f"{A}\nthe rest of document number {k}\nshared by some of them, {k % 20}") for k in range(200)]
    rows += [(77, f"{A}\none more row of the same document {k % 3}") for k in range(100)]
    assert found(make_docs(rows)) == brute(rows)


def test_other_limits_and_odd_rows(make_docs, odd_docs, no_docs, crowded_names, sample):
    assert found(make_docs(sample), least_chars=5, least_docs=2, batches=3) == brute(sample, 5, 2)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []
    assert len(found(crowded_names)) == 5


def test_adding_a_batch_again_changes_nothing(spark, make_docs):
    pairs = linededup.lines(make_docs([(i, f"{A}\nline that only two documents have {i // 2}") for i in range(8)]))
    once, twice = linededup.LineRuns(spark, 4), linededup.LineRuns(spark, 4)
    for batch in linededup._batches(pairs, 3):
        once.add(batch)
        twice.add(batch)
        twice.add(batch)
    a, b = once.repeated().collect(), twice.repeated().collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and [r.holder for r in a] == [7]
    once.close(), twice.close()


def test_settled_lines_leave_the_batch(spark, make_docs):
    index = linededup.LineRuns(spark, 4)
    index.add(linededup.lines(make_docs([(i, A) for i in range(10, 20)])))
    later = index.entries(linededup.lines(make_docs([(1, f"{A}\nbut this line is a new one"), (2, A)])))
    assert later.count() == 2 and index.new(later).count() == 1
    index.close()
