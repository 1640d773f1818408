import hashlib

import numpy as np

from lyrebird.llm import chat

HARD = ["", "</turn>\n", "\\", "<turn user>", "\\<", "a\nb", "é日\U0001f600", chat.EXTRA_TEXT, "x" * 5000]


def turns():
    rows = []
    for conv in range(12):
        for turn in range(conv % 5 + 1):
            rows.append((conv, turn, ["user", "assistant", "system", None, "odd>\n<\\role"][(conv + turn) % 5], HARD[(conv * 3 + turn) % len(HARD)], "x"))
    rows += [(3, 0, "assistant", "tie", "y"), (3, 0, "assistant", "tie", "y"), (None, 0, "user", None, "z"), (None, None, "assistant", "first", "z"), (-7, 0, "user", chat.EXTRA_TEXT, ""), (-7, 1, "assistant", chat.EXTRA_TEXT, "")]
    return rows + [(99, i, ["user", "assistant"][i % 2], f"turn {i} <", "") for i in range(3000)]


def brute(rows):
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest()
        out[conv] = (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    table = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    pieces = chat.format_chats(table)
    assert pieces.count() > 14  # the long conversation spreads over batches
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pieces).collect()}
    assert found == brute(turns())
    sizes = {r.conv_id: r.formatted_chars for r in chat.read_back(pieces).collect()}
    whole = {}
    for r in pieces.collect():
        whole[r.conv_id] = whole.get(r.conv_id, 0) + len(r.formatted)
        assert all(0 <= a <= b <= len(r.formatted.encode()) for a, b in zip(r.loss_start, r.loss_end, strict=True))
    assert sizes == whole
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0


def test_assembly_and_escapes():
    buffer, starts = chat.assemble([(np.array([1, 0]), np.frombuffer(b"a", np.uint8)), (np.array([2, 3]), np.frombuffer(b"bbccc", np.uint8))])
    assert buffer.tobytes() == b"abbccc" and starts.tolist() == [[0, 1], [3, 3]]
    assert chat.parse(b"<turn user>\\\\ \\<turn x></turn>\n") == [(b"user", b"\\ <turn x>")]
    for bad in (b"<turn user>a", b"x<turn user>a</turn>\n", b"<turn user>a<b</turn>\n"):
        try:
            chat.parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
