from driftlens.llm import chat


def brute(rows):
    out, convs = set(), {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or "", turn))
    for conv, turns in convs.items():
        turns.sort(key=lambda x: x[:4])
        for who in {t[2] for t in turns} - {"system"}:
            at = 0
            for seq, (_, _, role, text, turn) in enumerate(turns):
                head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == who else f"<|user name={role}|>\n"
                segment = head + text + "<|end|>\n"
                mask = (at + len(head), at + len(segment)) if role == who else (None, None)
                out.add((conv, who, seq, turn, role, segment, at, *mask))
                at += len(segment)
    return out


def test_against_brute_force(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "anna", "Hi"), (1, 2, "bo", "Ho ü"), (1, 3, "cy", None), (2, 0, "anna", ""), (2, 0, "anna", ""), (2, None, None, "x"),
            (None, 5, "bo", "lost"), (3, 0, "system", "alone"), *[(4, k, "ab"[k % 2], f"t{k}") for k in range(300)], (5, -7, "q", "early"), (5, 900, "r", "late")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, n int")
    got = [tuple(r) for r in chat.perspectives(docs, chunk=16).collect()]
    assert {g for g in got} == brute(rows)


def test_no_rows(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
