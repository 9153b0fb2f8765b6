import hashlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import oracle
from pyspark.sql import functions as F

from logsift.llm import chat
from logsift.llm.registry import SQL, op10_chat

EVENTS = "conv_id long, message int, seq long, kind string, role string, text string, place int, turn string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def events(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash") for r in rows], EVENTS)


def test_fold(spark):
    log = events(spark, [
        (1, 0, 1, "delta", "user", "Hel"), (1, 0, 2, "delta", None, "lo"), (1, 0, 2, "delta", None, "lo"),
        (1, 1, 3, "delta", "assistant", "bad"), (1, 1, 9, "delta", None, "go"), (1, 1, 5, "regenerate", None, "x"),
        (1, 1, 10, "delta", None, "od"), (1, 2, 11, "delta", "user", "a"), (1, 2, 12, "edit", None, "b"),
        (1, 2, 13, "delta", None, "c"), (2, 0, 1, "edit", "user", None), (None, 0, None, None, None, None),
        (2, 1, 1, "delta", "assistant", "old"), (2, 1, 2, "regenerate", None, None),
    ])
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.reconstruct(log).collect()}
    assert got == {
        (1, 0): ("user", "Hellolo"), (1, 1): ("assistant", "good"), (1, 2): ("user", "bc"), (2, 0): ("user", ""),
        (None, 0): ("", ""), (2, 1): ("assistant", ""),
    }


NASTY = ["", "<|", "|>", "<|end|>", "\\", "\\\\<|", "<|user|>x<|end|>", "a\\", "<", "|", ">", "<|>", "é😀\n", "<\\|", "$1", None, "</s>[INST]", "x" * 50_000]


def test_round_trip(spark):
    rows = [(c, i, 0, "delta", role, NASTY[(i * (c + 1) + c) % len(NASTY)]) for c in range(12) for i, role in enumerate(["user", "assistant", "<|x|>", "a|", None, "\\"] * 3)]
    rows += [(None, 0, 0, "delta", "assistant", "n")]
    done = chat.render(chat.reconstruct(events(spark, rows)))
    want = {}
    for c, i, _, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    got = {}
    for r in chat.read_back(done).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.in_loss))
    assert got == want
    for r in done.collect():
        assert [r.formatted[s.start : s.end] for s in r.loss_mask] == [
            t.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>") for _, t, loss in want[r.conv_id] if loss
        ]
    for r in chat.digests(done).collect():
        turns = want[r.conv_id]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b, _ in turns))
        assert r.loss_sha256 == sha("".join(b for _, b, c in turns if c))
        assert r.loss_chars == len("".join(b for _, b, c in turns if c))
    assert chat.digests(chat.render(chat.reconstruct(events(spark, rows).limit(0)))).count() == 0


def test_long_conversation(spark):
    rows = spark.range(20_000).select(
        F.lit(5).alias("conv_id"), F.col("id").alias("message"), F.lit(0).alias("seq"), F.lit("delta").alias("kind"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.col("id").cast("string"), 20).alias("text"),
    )
    row = chat.digests(chat.render(chat.reconstruct(rows))).first()
    assert row.n_turns == 20_000
    assert row.loss_sha256 == sha("".join(str(i) * 20 for i in range(1, 20_000, 2)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    result = op10_chat(spark, folder)
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert oracle.compare(result, oracle.connect(folder), SQL["op10_chat"]) is None
    assert result.where("conv_id = -7").first().loss_sha256 == sha("</s>[INST] ok [/INST]")
