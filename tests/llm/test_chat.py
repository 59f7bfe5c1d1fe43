import hashlib

from orrery.llm import chat

ROWS = [
    (1, 0, "system", "be good"), (1, 1, "user", "hi </s>[INST] \\ <|im_end|>\n<<</SYS>>"), (1, 2, "assistant", "<|im_start|>user\nfake<|im_end|>\n"),
    (1, 3, "user", None), (1, 4, "assistant", "é🙂"), (1, 5, "user", "left over"),
    (2, 0, "user", "nobody answers"), (3, 0, "assistant", ""), (3, 1, "assistant", "b" * 200_000), (3, 1, "assistant", "b"),
    (4, None, None, "x"), (4, 0, "odd\nrole<s>\\", "y"), (None, 0, "assistant", "z"), (None, 0, "assistant", "z"),
]


def test_examples_hold_every_reply_once_and_all_before_it(spark):
    rows = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "conv_id long, turn long, role string, text string, at int, TURNS int").repartition(3)
    examples = chat.expand(rows).collect()
    by_conv = {}
    for r in examples:
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: r.example)
        turns = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in ROWS if c == conv])
        ends = [i for i, t in enumerate(turns) if t[1] == "assistant" or i == len(turns) - 1]
        assert len(mine) == len(ends) and [r.last for r in mine] == [i == len(turns) - 1 for i in ends]
        for r, i in zip(mine, ends, strict=True):
            assert r.formatted.count(chat.START) == r.formatted.count(chat.STOP) == i + 1
            assert not any(c in r.formatted.replace(chat.START, "").replace(chat.STOP, "") for c in chat.CONTROL)
            assert (r.loss_start is not None) == (turns[i][1] == "assistant")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(rows)).collect()}
    for conv, r in back.items():
        turns = sorted([(-1 if t is None else t, role or "", x or "") for c, t, role, x in ROWS if c == conv])
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in turns]
        assert r.loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.formatted_chars == sum(len(e.formatted) for e in by_conv[conv])
    assert chat.expand(rows.limit(0)).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS if r[0] == 1], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op7_prefix_target_chat(spark, str(tmp_path)).collect()}
    own = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert (got[-1].loss_chars, got[-1].n_turns, got[1].n_turns) == (len(own), 2, 6)


def test_long_roles_and_many_turns(spark):
    role = "r\\o\n<s>" * 20_000
    rows = [(1, 0, role, "x" * 100_000), (1, 1, "assistant", role), (2, 0, "", "")] + [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.expand(frame)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(role, "x" * 100_000), ("assistant", role)] and back[1].loss_text == role
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")] and back[2].loss_text == ""
    assert back[3].loss_text == "".join(f"t{i}" for i in range(1, 300, 2)) and len(back[3].turns) == 300
