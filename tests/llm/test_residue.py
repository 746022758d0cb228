import random

from faultline.llm.residue import find_residue, judge, learn, passages_of, repeats

R = random.Random(9)
PLAIN = ["The run in {p} ended at step {n} without a reply.", "We compared the trace with {n} good runs.", "Der Lauf in {p} endete bei Schritt {n} ohne Antwort.", "La ejecución en {p} terminó en el paso {n}.", "Placeholders such as [NAME] were all filled, we checked {n} letters.", "The prompt template fills `{{{{goal}}}}` before step {n}.", "The card masks numbers as <ID> and dates as <DATE>.", "Access denied was the honest result of step {n}, since it had no right to read.", "Reviewers asked why the words 'page not found' were an answer.", "for s in steps: print(\"%s %d\" % (s.name, s.idx))"]
BAD = ["On {{city}} the agent stopped at {{step}}.", "Dear ${NAME}, your case was handled by ${OWNER}.", "Owner of this note: _______.", "lorem dolore ipsam quidem fugit lorem maros", "TBD", "404 Not Found", "Please enable JavaScript to view this report.", "Zugriff verweigert.", "sample text sample text sample text sample text."]


def _plain():
    return "\n".join(R.choice(PLAIN).format(p=R.choice(["Castrel", "Pellworth"]), n=R.randint(1, 99)) for _ in range(6))


def test_held_out_accuracy(spark):
    rows = [(i, _plain()) for i in range(600)]
    rows += [(10_000 + i, _plain() + "\n" + x if k % 2 and x[0] in "OD_l" else x) for i, (k, x) in enumerate((k, x) for k in range(6) for x in BAD)]
    latin = "dolore ipsam quidem fugit maros nulla".split()
    rows += [(15_000 + i, "lorem " + " ".join(R.choice(latin) for _ in range(6))) for i in range(12)]
    # shapes that no trusted pattern names: learned from what is said around the others
    rows += [(20_000, "On <city> the agent stopped at <step>."), (20_001, "Dear <name>, your case was handled by <owner>."), (20_002, "fugit maros quidem ipsam dolore maros")]
    rows += [(30_000, ""), (30_001, None), (30_002, "   \n"), (30_003, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as odds", "'x' as kind")
    got = {r.doc_id for r in find_residue(df).collect()}
    want = {i for i, _ in rows if 10_000 <= i < 30_000}
    assert want <= got and not (got - want - {30_003})


def test_no_trusted_passage_and_empty(spark):
    df = spark.createDataFrame([(i, "The run ended at step 4.") for i in range(5)], "doc_id long, text string")
    assert find_residue(df).count() == 0 and find_residue(df.limit(0)).count() == 0
    assert learn(df).prior < -1000


def test_passages_leave_code_quotes_and_masks_out():
    got = passages_of('1. One `{{x}}` two.\n```\n{{code}}\n```\n{"tool": "t", "note": "kept note here"}\n[user] said \'page not found\' today <ID>')
    assert got == ["One code two.", "kept note here", "said quoted today mask"]


def test_the_score_alone_decides(spark):
    rows = [(i, _plain()) for i in range(300)] + [(1_000 + i, x) for i in range(30) for x in BAD[:2]]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"))
    assert judge(model, "Reviewers asked why the honest result of step 4 was {{goal}}, since it had no right to read.")[1] == ""
    assert judge(model, BAD[0])[1] == "slot"
    assert repeats(["sample", "text"] * 4) and not repeats("the run ended at step".split() * 20)
