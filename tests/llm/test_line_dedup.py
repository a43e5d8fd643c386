"""Line dedup against all runs of all documents."""
from assaykit.llm import line_dedup
from tests.llm.helpers import documents, odd_docs, words

A, B, C = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 40), ("v", 10), ("u", 12)))


def brute(docs, least):
    """docs: (order, text) in order. Lines that lie in a run found before, a
    single line of MIN_LINE_WORDS words being a run as well."""
    seen, out = {}, {}
    for key, text in docs:
        told = [(i, tuple(words(x))) for i, x in enumerate((text or "").split("\n"))]
        told = [x for x in told if x[1]]
        gone = set()
        for a in range(len(told)):
            n = 0
            for b in range(a, len(told)):
                n += len(told[b][1])
                if n >= least or a == b and n >= line_dedup.MIN_LINE_WORDS:
                    run = tuple(x[1] for x in told[a:b + 1])
                    if seen.setdefault(run, (key, a)) != (key, a):
                        gone.update(range(told[a][0], told[b][0] + 1))
                if n > 4 * least + 200:
                    break
        out[key, text] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_against_all_runs(spark):
    extra = ["\n".join([A, B, C, A, "x"]), "\n".join(["y", B, "", "  " + C, B, B, "z"]), "\n".join([B] * 9), "\n".join(["q"] + [B] * 4),
             "\n".join([C, B, C, "k", C, B, C]), None, "", "\n".join(["\t" + A, "tail"])]
    df = documents(spark, [(10**6 + i, t) for i, t in enumerate(extra)]).select("doc_id", "text")
    rows = df.collect()
    want = brute(sorted((r.doc_id, r.text) for r in rows if r.text is not None) + [(r.doc_id, None) for r in rows if r.text is None], line_dedup.MIN_RUN_WORDS)
    got = {r.doc_id: r.text for r in line_dedup.report(df).collect()}
    assert {(k, t): got[k] for k, t in want} == want
    assert any(got[k] != t for k, t in want)


def test_long_shared_passage(spark):
    """A copy of a document goes line by line; its own lines stay."""
    body = [" ".join(f"{p}{i}" for i in range(60)) for p in "abc"]
    df = spark.createDataFrame([(1, "\n".join(["own one", *body])), (2, "\n".join([*body, "own two"])), (3, "\n".join(body))], "doc_id long, text string")
    assert [r.text for r in line_dedup.report(df).orderBy("doc_id").collect()] == ["\n".join(["own one", *body]), "own two", ""]


def test_odd_rows(spark):
    df = odd_docs(spark, [A, A + "\nx"])
    out = line_dedup.rewrite(df)
    assert out.columns == df.columns and out.count() == df.count()
    new = {r.doc_id: (r.text, r.n_chars) for r in out.where("doc_id >= 100 or doc_id = 1").collect()}
    assert new == {100: (A, len(A)), 101: ("x", 1), 1: (None, None)}
    assert line_dedup.report(df.limit(0)).count() == 0


def test_single_lines(spark):
    """A line of eight words goes at its later places, one of seven stays."""
    eight, seven = "one two three four five six seven eight", "a b c d e f g"
    df = spark.createDataFrame([(1, f"{eight}\n{seven}\nx"), (2, f"y\n {eight}\n{seven}"), (3, f"{eight} nine\n{seven}\n{eight}\nz")], "doc_id long, text string")
    assert [r.text for r in line_dedup.report(df).orderBy("doc_id").collect()] == [f"{eight}\n{seven}\nx", f"y\n{seven}", f"{eight} nine\n{seven}\nz"]
