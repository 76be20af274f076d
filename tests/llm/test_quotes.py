import random

import duckdb

from media_analytics.llm import quotes
from tools.check_oracle import compare


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, key string, position int")


def equal_sql(df):
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    ok, message = compare(quotes.conversations(df), con, quotes.OP7_SQL)
    assert ok, message


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(30):
        said = []
        for t in range(rng.randint(1, 9)):
            own = "\n".join(" ".join(rng.choices("alpha Beta gamma d e".split(), k=rng.randint(0, 5)))
                            for _ in range(rng.randint(0, 3)))
            quoted = ""
            if said and rng.random() < 0.7:
                lines = rng.choice(said).split("\n")
                quoted = "\n".join(rng.choice(["> ", ">", " >  "]) + x for x in lines[rng.randint(0, len(lines)):]) + "\n"
            if rng.random() < 0.1:
                quoted += "> > > unknown\r\n"
            text = rng.choice([quoted + own, own + "\n" + quoted, None if rng.random() < 0.2 else own])
            said += [text] if text else []
            row = (c if rng.random() < 0.97 else None, t if rng.random() < 0.97 else None,
                   rng.choice(["user", "assistant", None]), text)
            rows += [row] * (2 if rng.random() < 0.1 else 1)
    return rows


def test_random_conversations_equal_the_sql(spark):
    equal_sql(frame(spark, random_rows(1)))


def random_mail(seed):
    """Messages of paragraphs and sentences that quote re-wrapped parts of earlier ones, also of
    8 to 14 words, with repeated sentences and two levels."""
    rng = random.Random(seed)
    rows = []
    for c in range(25):
        said = []
        for t in range(7):
            sentences = [" ".join(rng.choices("we meet on Monday the budget is late and so the plan must wait".split(), k=rng.randint(1, 14)))
                         + rng.choice([".", "!", '."', "?)", "。"]) for _ in range(rng.randint(1, 6))]
            own = [" ".join(sentences[k:k + 2]).split() for k in range(0, len(sentences), 2)]
            quoted = ""
            if said and rng.random() < 0.8:
                words = rng.choice(rng.choice(said))
                a = rng.randrange(len(words))
                part = rng.choice([words, words[a:a + rng.randint(1, 14)], words[a:]])
                quoted = wrapped(rng, part, rng.choice(["> ", "> > ", ">"])) + "\n"
            said.append(own)
            rows.append((c, t, "user", quoted + rng.choice(["\n\n", "\n \n", "\n"]).join(wrapped(rng, p, "") for p in own)))
    return rows


def test_random_rewrapped_mail_equals_the_sql(spark):
    for seed in (1, 2):
        equal_sql(frame(spark, random_mail(seed)))


def test_phrases_are_made_only_where_they_can_win(spark, monkeypatch):
    """Runs linked by a longer part need none."""
    asked, real = [], quotes._best
    monkeypatch.setattr(quotes, "_best", lambda quoted, own: asked.append((quoted.count(), own.count())) or real(quoted, own))
    long = "this whole sentence has more than eight words in it."
    rows = [(c, 0, "user", long + " And more of them follow here now and then.") for c in range(5)]
    rows += [(c, 1, "user", "> " + (long if c else "has more than eight words in it. And more of them")) for c in range(5)]
    got = {(r.conv_id, r.turn): r.parent_turn for r in quotes.conversations(frame(spark, rows)).collect()}
    assert all(got[c, 1] == 0 for c in range(5))
    assert asked == [(5, 5), (1, 1)]


def test_links_levels_and_order(spark):
    rows = [(1, 0, "user", "First thought\nsecond line"), (1, 1, "assistant", "A new topic"),
            (1, 2, "user", "> first   THOUGHT\n> second line\nmy answer"),
            (1, 3, "assistant", "> > First thought\n> > second line\n> my answer\nagreed"),
            (1, 4, "user", "> A new topic\nyes"), (2, 0, "user", "> First thought\nother talk")]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(frame(spark, rows)).collect()}
    assert [got[1, t].parent_turn for t in range(5)] == [None, None, 0, 2, 1]
    assert [got[1, t].root_turn for t in range(5)] == [0, 1, 0, 0, 1]
    assert sorted(range(5), key=lambda t: got[1, t].position) == [0, 2, 3, 1, 4]
    assert got[1, 3].text == "agreed" and got[1, 3].n_quoted == 2 and got[1, 3].n_linked == 2
    assert got[2, 0].parent_turn is None and got[2, 0].n_quoted == 1 and got[2, 0].n_linked == 0
    assert got[1, 2].formatted == "<|user|>\nmy answer\n<|end|>"


def parents(spark, rows):
    got = quotes.conversations(frame(spark, [(1, t, "user", x) for t, x in enumerate(rows)])).collect()
    return {r.turn: (r.parent_turn, r.n_quoted, r.n_linked) for r in got}


def test_rewrapped_and_partial_quotes(spark):
    mail = ("Dear all, the meeting\nmoves to Monday. Please bring\nyour notes along.\n\n"
            "The second topic is the budget\nof next year which nobody\nhas read so far\n \nBye")
    got = parents(spark, [
        mail, "Something else. It has two sentences!",
        "> Dear all, the meeting moves to\n> Monday. Please bring your notes along.\nyes",     # one paragraph, re-wrapped
        "> The second topic is the\n> budget of next year which nobody has\n> read so far\nno",  # the other one
        "> please bring your\n> notes along.\nsure",                                           # one sentence over lines
        "> It has two sentences!\nright",                                                      # one sentence of a line
        "> second topic is the budget of next year\n> which nobody\nhm",                        # a part, re-wrapped
        "> yes\nso be it",                                                                    # a line
        "> > Dear all, the\n> > meeting moves to Monday.\n> sure\nfine",                       # two levels
        "> Never said by anyone in this talk at all\nwhat?"])
    assert {t: p for t, (p, _, _) in got.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 2, 8: 4, 9: None}
    assert got[8][1:] == (2, 2) and got[9][1:] == (1, 0) and all(got[t][1:] == (1, 1) for t in range(2, 8))


def test_random_rewrapped_paragraphs_find_their_message(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for c in range(20):
        said = []
        for t in range(6):
            # words of this message only, in paragraphs of several lines
            paragraphs = [[f"w{c}x{t}x{p}x{k}" for k in range(rng.randint(3, 20))] for p in range(rng.randint(1, 4))]
            quoted = ""
            if said and rng.random() < 0.7:
                want[c, t] = rng.randrange(len(said))
                quoted = wrapped(rng, rng.choice(said[want[c, t]]), "> ") + "\n"
            said.append(paragraphs)
            rows.append((c, t, "user", quoted + "\n\n".join(wrapped(rng, p, "") for p in paragraphs)))
    got = quotes.conversations(frame(spark, rows)).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got if r.parent_turn is not None} == want


def wrapped(rng, words, sign):
    n = rng.randint(2, 7)
    return "\n".join(sign + " ".join(words[k:k + n]) for k in range(0, len(words), n))


def test_one_hot_conversation(spark):
    rows = [(1, 0, "user", "the same line")] + [(1, t, "user", "> the same line\nthe same line") for t in range(1, 300)]
    got = quotes.conversations(frame(spark, rows)).collect()
    assert {r.parent_turn for r in got} == {None, 0} and sorted(r.position for r in got) == list(range(300))


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 60)]
    got = quotes.conversations(frame(spark, rows)).collect()
    assert {r.root_turn for r in got} == {0} and all(r.parent_turn == r.turn - 1 for r in got if r.turn)


def test_no_python_and_empty(spark):
    df = frame(spark, [(1, 0, "user", "> " * 5000 + "x " * 50_000)])
    out = quotes.conversations(df)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert out.count() == 1 and quotes.conversations(df.limit(0)).count() == 0
