import hashlib
import random

import pytest

from kinsum.llm import line_dedup as ld


def brute(rows, run):
    """rows: (id, text) with unique (id, text) order; what is left of each text."""
    seen, out = {}, []
    lines = [((t or "").split("\n")) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in order:
        for p in range(len(lines[k]) - run + 1):
            seen.setdefault(tuple(lines[k][p : p + run]), (k, p))
    for k, (i, t) in enumerate(rows):
        gone = set()
        for p in range(len(lines[k]) - run + 1):
            if seen[tuple(lines[k][p : p + run])] != (k, p):
                gone.update(range(p, p + run))
        left = [x for p, x in enumerate(lines[k]) if p not in gone]
        runs = sum(p in gone and p - 1 not in gone for p in range(len(lines[k])))
        out.append((i, len(lines[k]), len(gone), runs, t if not gone else "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_brute_force(make, odd, real, run):
    rnd = random.Random(run)
    texts = [t for t in odd if t not in ("", None)] + [t for _, t in real]
    texts += ["\n".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    texts += ["head %d\nshared one\nshared two\nshared three\nshared four\ntail %d" % (k, k) for k in range(60)]
    rows = [*enumerate(texts), (None, "shared two\nshared three\nshared four\nx")]
    out = ld.line_dedup(make(rows), run, None).collect()
    assert sorted(((r.doc_id, r._n_lines, r._n_removed, r._n_runs, r.text) for r in out), key=repr) == brute(rows, run)


def brute_words(rows, run, words):
    """Windows of ``run`` lines, and of the first fewer lines that hold ``words`` words."""
    lines = [(t or "").split("\n") for _, t in rows]

    def ends(x):
        for p in range(len(x)):
            held = [e for e in range(p + 1, min(p + run, len(x) + 1)) if sum(len(y.encode().split()) for y in x[p:e]) >= words]
            yield from [(p, e) for e in held[:1]]
            if p + run <= len(x):
                yield p, p + run

    seen, out = {}, []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0)):
        for p, e in ends(lines[k]):
            seen.setdefault(tuple(lines[k][p:e]), (k, p))
    for k, (i, _) in enumerate(rows):
        gone = {q for p, e in ends(lines[k]) if seen[tuple(lines[k][p:e])] != (k, p) for q in range(p, e)}
        runs = sum(p in gone and p - 1 not in gone for p in range(len(lines[k])))
        out.append((i, len(lines[k]), len(gone), runs, rows[k][1] if not gone else "\n".join(x for p, x in enumerate(lines[k]) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [4, ld.WORDS])
def test_long_passages_of_few_lines(make, odd, real, words):
    rnd = random.Random(words)
    long = [" ".join(f"w{rnd.randrange(99)}" for _ in range(n)) for n in (2, 3, 4, 24, 25, 26, 49, 50, 57)]
    texts = [t for t in odd if t not in ("", None)] + [t for _, t in real]
    texts += ["\n".join(rnd.choice([*long, *"abc"]) for _ in range(rnd.randint(1, 9))) for _ in range(150)]
    rows = list(enumerate(texts))
    rows += [(1000, f"x\n{' '.join('p%d' % i for i in range(57))}\ny"), (1001, " ".join("p%d" % i for i in range(57)))]
    out = ld.line_dedup(make(rows), words=words).collect()
    got = sorted(((r.doc_id, r._n_lines, r._n_removed, r._n_runs, r.text) for r in out), key=repr)
    assert got == brute_words(rows, ld.RUN, words)
    assert next(r for r in out if r.doc_id == 1001)._n_removed == 1
    before = {r.doc_id: r._n_removed for r in ld.line_dedup(make(rows), words=None).collect()}
    assert all(r._n_removed >= before[r.doc_id] for r in out)


def test_rows_that_repeat_and_nulls(make):
    t = "a\nb\nc\nd"
    out = ld.line_digest(make([(1, t), (1, t), (2, t), (3, None), (3, "")])).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in out) == [(1, 4, 0, sha(t)), (1, 4, 0, sha(t)), (2, 4, 4, sha("")), (3, 1, 0, sha("")), (3, 1, 0, sha(""))]


def test_columns_pass_and_empty_table(make, spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 7, "k"), (2, "a\nb\nc", 8, None)], "doc_id long, text string, pos int, f string")
    out = ld.line_dedup(df).orderBy("doc_id").collect()
    assert [(r.text, r.pos, r.f) for r in out] == [("a\nb\nc", 7, "k"), ("", 8, None)]
    assert ld.line_dedup(make([])).collect() == []


def test_clashing_names_and_the_least_id(make, spark):
    """Columns named like the operator's own come back untouched; null is not the least id."""
    rows = [(5, "a\nb\nc"), (None, "a\nb\nc"), (-(1 << 63), "a\nb\nc"), (6, "other")]
    names = ["_id", "_t", "_lines", "_n_lines", "_runs", "_N_REMOVED", "h", "pos", "f"]
    df = spark.createDataFrame([(i, t, *[f"{k}-{n}" for n in names]) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_removed", "_n_runs"]
    got = {r.doc_id: r for r in out.collect()}
    for k, (i, _) in enumerate(rows):
        assert [got[i][n] for n in names] == [f"{k}-{n}" for n in names]
    assert {i: (r.text, r.asDict()["__n_removed"]) for i, r in got.items()} == {None: ("a\nb\nc", 0), -(1 << 63): ("", 3), 5: ("", 3), 6: ("other", 0)}


def test_no_python_in_the_plan(make):
    plan = ld.line_dedup(make(["a\nb\nc"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
