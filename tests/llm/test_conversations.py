"""Chat formatting and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tocsin.llm import chat, queries
from tocsin.llm import conversation_repair as repair

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<<|", "a<|\\|>", "", "\n\nuser\n", "<|endoftext|>", "naïve 日本 😀", " " * 12000 + "x", "x" * 40000, "\\<|"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    """With extra columns whose names the operators use themselves."""
    full = [(*r, "p", 3, b"i") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, part string, n_turns int, ids binary")


def messy_turns(seed=4):
    rng = random.Random(seed)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(ODD)) for k in range(300)]  # most rows are of one conversation
    rows += [(2, None, "user", "x"), (2, 5, None, None), (2, 5, None, None), (None, 1, "assistant", "lost"), (None, None, "user", "lost"), (3, 0, "a\\b\nc <|im_start|>", "role of signs")]
    rows += [(10 + k // 3, k % 3, ("user", "assistant", "user")[k % 3], rng.choice(ODD) + rng.choice(["", ".", "! "])) for k in range(120)]
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn, role, text))
    order = lambda t: (t[0] is not None, t[0] or 0, (t[1] or "").encode(), (t[2] or "").encode())
    return {c: sorted(ts, key=order) for c, ts in found.items()}


def test_escapes_are_reversible():
    for parts in itertools.product(["<", "\\", "|", "x"], repeat=6):
        text = "".join(parts)
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_assembly_equals_segments():
    own = chat.Vocabulary(*PATHS)
    ids, loss, begin = chat.assemble(own, ["user", "assistant", "assistant"], ["hi <|im_end|>", "yes", ""], "assistant")
    assert begin.tolist()[0] == 0 and begin[-1] == len(ids) and (ids == chat.START).sum() == (ids == chat.END).sum() == 3
    turns, learnt, chars = chat.read_part(own, ids, loss)
    assert turns == [("user", "hi <|im_end|>"), ("assistant", "yes"), ("assistant", "")] and learnt == ["yes"]
    written = "".join(f"<|im_start|>{r}\n{chat.escape(t)}<|im_end|>\n" for r, t in turns)
    assert chars == len(written)
    for text in ODD:  # both forms of the vocabulary give the same ids
        assert own.encode(text).tolist() == own.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("part_ids", "pending"), [(1 << 16, 1 << 22), (50, 300)])
def test_chat(spark, part_ids, pending):
    rows = messy_turns()
    formatted = chat.format_chat(conversations(spark, rows).repartition(6), *PATHS, part_ids=part_ids)
    found = chat.chat_digests(formatted, *PATHS, pending_bytes=pending).collect()
    want = by_conversation(rows)
    assert len(found) == len(want) and {r["conv_id"] for r in found} == set(want)
    for r in found:
        turns = [(role or "", text or "") for _, role, text in want[r["conv_id"]]]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), sha(learnt))
    parts = formatted.collect()
    assert all(len(p["ids"]) == 4 * len(p["loss"]) for p in parts)
    assert chat.chat_digests(chat.format_chat(conversations(spark, rows).limit(0), *PATHS), *PATHS).count() == 0


def edits_by_hand(rows, most_inserted=4):
    """The cheapest (cost, audit) over all edits of [(fault, initial)], by trying them."""
    best = None
    for choice in itertools.product("KRD", repeat=len(rows)):
        for inserted in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(inserted) > most_inserted:
                continue
            cost, audit, letters = 0, "", []
            for k, n in enumerate(inserted):
                audit, letters, cost = audit + "I" * n, letters + ["ua"] * n, cost + 2 * n
                if k < len(rows):
                    fault, initial = rows[k]
                    edit = choice[k]
                    audit += edit
                    if edit == "D":
                        cost += 3
                    else:
                        if fault in "bd":
                            cost += 1000
                        cost += (2 if edit == "R" else 0) + (fault == "t")
                        letters.append("ua" if edit == "R" else initial)
            if best and (cost, audit) >= best:
                continue
            if any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*letters)):
                best = (cost, audit)
    return best


def every_split(codes):
    """Cells of all spans by all their splits."""
    cells = {(k, k + 1): repair.LEAVES[c] for k, c in enumerate(codes)}
    for size in range(2, len(codes) + 1):
        for a in range(len(codes) - size + 1):
            out = {}
            for k in range(a + 1, a + size):
                for key, found in repair.combine(cells[a, k], cells[k, a + size]).items():
                    out[key] = min(found, out.get(key, found))
            cells[a, a + size] = out
    return cells[0, len(codes)]


def test_parsing_equals_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4):
        for _ in range(1 if n == 0 else 16 if n < 4 else 8):
            rows = [(rng.choice("ooobdt"), rng.choice("suuaax")) for _ in range(n)]
            assert repair.solution(repair.parse([repair.LEAVES[f + i] for f, i in rows])) == edits_by_hand(rows, min(n + 1, 4)), rows


def test_one_split_is_enough():
    rng = random.Random(6)
    for _ in range(40):
        codes = [rng.choice("oooobdt") + rng.choice("suuaax") for _ in range(rng.randrange(1, 24))]
        assert repair.parse([repair.LEAVES[c] for c in codes]) == every_split(codes)


def repaired_by_hand(original):
    """Damage and repair of plain rows; the least edits by going from row to row."""
    rows = defaultdict(list)
    for conv, turn, role, text in original:
        rows[conv]
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in rows.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {("", ""): (0, "", ())}  # (last letter, whether any pair began) -> cost, audit, lines

        def step(best, extra):
            new = dict(best)
            for state, value in extra:
                if state not in new or value[:2] < new[state][:2]:
                    new[state] = value
            return new

        follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        def inserted(best):
            for _ in range(3):
                best = step(best, [((follow[s, x], ""), (c + 2, a + "I", (*o, f"{'user' if x == 'u' else 'assistant'}:"))) for (s, _), (c, a, o) in best.items() for x in "ua" if (s, x) in follow])
            return best

        best = inserted(best)
        for (_, role, text), fault in zip(own, faults):
            options = []
            for (s, _), (c, a, o) in best.items():
                options.append(((s, ""), (c + 3, a + "D", o)))
                if fault not in ("blank", "duplicate"):
                    for cost, new, edit in ((0, role, "K"), (2, "user", "R"), (2, "assistant", "R")):
                        if (s, new[:1]) in follow:
                            options.append(((follow[s, new[:1]], ""), (c + cost + (fault == "truncated"), a + edit, (*o, f"{new}:{text}"))))
            best = inserted(step({}, options))
        cost, audit, lines = min(best[s] for s in (("", ""), ("a", "")) if s in best)
        turns = {t for t, _, _ in own if t is not None}
        letters = [r[:1] for _, r, _ in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(letters[:-1], letters[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines)))
    return out


def repaired(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("piece", [1024, 7])
def test_repair(spark, piece):
    rng = random.Random(7)
    rows = messy_turns(8) + [(500, k * 3, rng.choice(["user", "assistant", "tool", ""]), rng.choice(["a.", "b", " ", "c?"])) for k in range(200)] + [(77, 20 * k, "user", "gone") for k in range(3)]
    rows += [(900 + k, 0, "user", "alone.") for k in range(60)]  # of some, all rows are dropped
    table = conversations(spark, rows)
    found = repair.repair_conversations(table, repair.damage(table.repartition(5)), piece=piece)
    assert found.count() == len({r[0] for r in rows})
    want = repaired_by_hand(rows)
    assert repaired(found) == want
    assert any(w[6] == "" and w[5] == 0 for w in want.values())
    nothing = table.limit(0)
    assert repair.repair_conversations(nothing, repair.damage(nothing)).count() == 0


def test_registered_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(queries.op13_conversation_repair(spark, SF)) == repaired_by_hand(rows)


def test_slices():
    assert repair.slices("IKDDIIRI", [1, 2, 1]) == ["IK", "DD", "IIRI"] and np.array_equal(repair.slices("", []), [])
