import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from same import assert_same

from tilewright.llm import chat as C
from tilewright.llm import registry

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "\\", "<", "[", "/", "ok", " ", "\n", "$1", "é😀"]


def plain_fold(events):
    """Messages of a log, event by event in order."""
    by = {}
    for e in sorted(set(events), key=lambda e: (e[1], e[3] == "delta", e[3], e[5] or "")):
        by.setdefault((e[0], e[2]), []).append(e)
    out = {}
    for (conv, message), own in by.items():
        text, rewound, role = "", None, None
        for _, seq, _, kind, name, body in own:
            text = "" if kind == "regenerate" else body or "" if kind in ("open", "edit") else text + (body or "")
            rewound = seq if kind == "regenerate" else rewound
            role = name or role
        out.setdefault(conv, []).append((own[0][1], message, role, text, rewound))
    return {conv: [m[:4] for m in own if not any(o[4] is not None and o[0] < m[0] < o[4] for o in own)] for conv, own in out.items()}


def test_query_equals_sql(spark, sf_dir, duck):
    assert_same(registry.op13_chat_format(spark, sf_dir).toPandas(), duck.sql(C.ORACLE).df())


def test_added_conversation(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    r = registry.op13_chat_format(spark, sf_dir).filter("conv_id = -7").first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = registry.op13_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_fold_equals_plain(spark):
    rng, events = random.Random(5), []
    for conv in range(40):
        seq, messages = 0, []
        for _ in range(rng.randrange(1, 25)):
            seq += rng.choice([0, 1, 1, 2])
            kind = rng.choice(C.KINDS) if messages else "open"
            message = len(messages) if kind == "open" else rng.choice(messages)
            messages += [message] if kind == "open" else []
            events.append((conv, seq, message, kind, rng.choice(["user", "assistant"]) if kind == "open" else None, rng.choice(["a", "b", None, "", "cd"])))
    events += rng.sample(events, 30)  # delivered twice
    rng.shuffle(events)
    got = {}
    for r in C.reconstruct(spark.createDataFrame(events, EVENTS).repartition(3)).collect():
        got.setdefault(r["conv_id"], []).append((r["opened"], r["message"], r["role"], r["text"]))
    want = plain_fold(events)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items() if v}


def test_regeneration_drops_what_followed(spark):
    events = [(1, 1, 1, "open", "user", "q"), (1, 2, 2, "open", "assistant", ""), (1, 3, 2, "delta", None, "bad"), (1, 4, 3, "open", "user", "why?"), (1, 5, 2, "regenerate", None, None),
              (1, 6, 2, "delta", None, "go"), (1, 7, 2, "delta", None, "od"), (1, 8, 4, "open", "user", "tanks"), (1, 9, 4, "edit", None, "thanks")]
    segments = C.render(C.reconstruct(spark.createDataFrame(events, EVENTS)))
    r = segments.select(C.formatted(F.col("segments")).alias("text"), F.filter("segments", lambda s: s["loss"]).alias("loss")).first()
    assert r["text"] == "[INST] q [/INST]<s>good</s>[INST] thanks [/INST]" and [s["text"] for s in r["loss"]] == ["good"]


def round_trip(spark, conversations):
    rows = [(c, i, i, role, text) for c, turns in enumerate(conversations) for i, (role, text) in enumerate(turns)]
    messages = spark.createDataFrame(rows, "conv_id long, opened long, message long, role string, text string")
    got = C.render(messages).select("conv_id", C.parsed(C.formatted(F.col("segments"))).alias("turns"), F.filter("segments", lambda s: s["loss"]).alias("loss")).collect()
    for r in got:
        want = [(role or "", text or "") for role, text in conversations[r["conv_id"]]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        for s in r["loss"]:
            assert not any(b in s["text"] for b in BITS[:9])
    assert len(got) == sum(bool(c) for c in conversations)


def test_round_trip(spark):
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "<<TEXT>>", "", None, "a<s>"]
    round_trip(spark, [[(rng.choice(roles), "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 6))] for _ in range(400)])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.text(st.sampled_from("<>[]/\\sINTSYROLEX"), max_size=20)), min_size=1, max_size=8))
def test_round_trip_of_any_signs(spark, turns):
    round_trip(spark, [turns])


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, None, "user", None), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (1, 2, None, "y"), (2, 0, "assistant", "long " * 400_000)],
                                 "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'k' as kind", "2 as message", "3 as opened", "4 as segments")
    got = {r["conv_id"]: r for r in C.report(C.render(C.reconstruct(C.log_of(rows)))).collect()}
    assert (got[None]["n_turns"], got[None]["loss_chars"], got[1]["n_turns"], got[1]["loss_chars"]) == (1, 0, 4, 2)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\n\ny\nassistant\nx\nassistant\nx\n").hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(("long " * 400_000).encode()).hexdigest()
    assert C.report(C.render(C.reconstruct(C.log_of(rows.limit(0))))).count() == 0


def test_a_long_conversation_is_linear(spark):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('é', id) as text")
    r = C.report(C.render(C.reconstruct(C.log_of(rows)))).first()
    assert r["n_turns"] == 20_000 and r["loss_chars"] == sum(len(str(i)) + 1 for i in range(1, 20_000, 2))
