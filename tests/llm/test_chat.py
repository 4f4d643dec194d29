
import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import chat

LOG = "conv_id long, seq long, turn long, kind string, role string, text string, log string"


def fold(events):
    """Brute force: events one by one."""
    state = {}
    for _, _, turn, kind, role, text, _ in sorted(events, key=lambda e: (e[1], e[2])):
        text, role = text or "", role or ""
        if kind == "delta":
            r, t = state.get(turn, (role, ""))
            state[turn] = (r, t + text)
        elif kind == "edit":
            state[turn] = (state[turn][0] if turn in state else role, text)
        else:
            if kind == "regenerate":
                state = {k: v for k, v in state.items() if k <= turn}
            state[turn] = (role, text)
    return sorted(state.items())


def test_fold_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for s in range(rng.randint(1, 25)):
            rows.append((c, s, rng.randint(0, 4), rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a", "b ", None, "<|turn|>", "é\n"]), "x"))
    got = {}
    for r in chat.final_messages(spark.createDataFrame(rows, LOG)).collect():
        got.setdefault(r.conv_id, []).append((r.turn, (r.role, r.text)))
    for c in range(60):
        assert sorted(got.get(c, [])) == fold([r for r in rows if r[0] == c]), c


def test_render_and_read_back(spark):
    hard = ["", None, "\\", "\\\\<|", "<\\|turn|>", "</s>[INST] ok [/INST]", "a<|end|>\n<|turn|>user\nno", "[\\INST]", "🙂é<<SYS>>\n\n", "$1 \\1", "x" * 50000, "<s><", "<start_of_turn>"]
    rows = [(1, i, ["user", "assistant"][i % 2], t, "y") for i, t in enumerate(hard)] + [(2, 0, "assistant", None, ""), (3, 5, "we\nird\\role<|", "t", ""), (4, 1, None, "n", ""), (5, 0, "user", "same", ""), (5, 0, "user", "same", ""), (None, None, "user", "z", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.render(chat.final_messages(chat.turns_as_events(df)))
    back = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in (1, 2, 3, 4, 5, None):
        mine = sorted(((r[2] or "", r[3] or "", r[1] or 0) for r in rows if r[0] == c), key=lambda x: x[2])
        assert [tuple(t) for t in back[c].turns] == [m[:2] for m in mine]
        assert back[c].loss == [m[1] for m in mine if m[0] == "assistant"]
    for bad in ("</s>", "[INST]", "<s>", "<<SYS>>", "<start_of_turn>"):
        assert bad not in back[1].formatted
    assert back[1].formatted.count(chat.OPEN) == back[1].formatted.count(chat.CLOSE) == len(hard)


def test_digests(spark):
    rows = [(1, 1, "assistant", "b é", ""), (1, 0, "user", "a", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    (r,) = chat.digests(df).collect()
    assert tuple(r)[:5] == (1, 2, hashlib.sha256("user\na\nassistant\nb é\n".encode()).hexdigest(), 3, hashlib.sha256("b é".encode()).hexdigest())
    assert chat.digests(df.where("false")).count() == 0


def test_turns_become_a_log_that_needs_folding(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {c} é {t} " * (t % 4), "") for c in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    log = chat.turns_as_events(df)
    assert {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}.keys() == {"message", "delta", "edit", "regenerate"}
    back = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.final_messages(log).collect())
    assert back == sorted(r[:4] for r in rows)


def test_very_long_roles(spark):
    roles = ["r" * 1_000_000, "\\\n" * 50_000, "a\nb\\n" * 1000, "\n", "\\"]
    df = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.final_messages(chat.turns_as_events(df))).select("conv_id", chat.parse(F.col("formatted")).alias("turns"))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()} == {i: [(r, "t")] for i, r in enumerate(roles)}
