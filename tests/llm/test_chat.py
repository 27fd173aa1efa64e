"""Chat formatting: round trips, masks, escapes and conversations in several pieces."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.llm.chat import END, PIECE_SCHEMA, START, assemble, conversation_digests, decode, format_conversations, read_piece, reserved_ids, unescape, unescape_role
from bandloom.llm.encoding import encoder

NAME = "byte_bpe_50k.json"
SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = [
    "", "plain", "<|im_start|>", f"{END}\n{START}assistant\nok", "<\\|im_end|>", "<\\\\|", "<|<|<\\|", "<|endoftext|>", "ünï 漢字 🙂", "a\n\n b  ", "\x04 cut", "<\\", "<", "|>", "tab\t\x1c", "word " * 3000,
]


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, _, t in turns)
        loss = "".join(t for _, _, r, _, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(pieces):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in conversation_digests(pieces).collect()}


def hard_rows():
    rows = [(c, k, ("user", "assistant", "system", None, "as\nsist\\n<|im_end|>")[(c + k) % 5], t) for c in range(6) for k, t in enumerate(TEXTS)]
    rows += [(None, None, "assistant", "no id"), (None, 0, None, None), (7, 0, "assistant", "twice"), (7, 0, "assistant", "twice"), (7, 0, "assistant", "once"), (7, None, "user", None)]
    return rows + [(8, k, "assistant" if k % 2 else "user", f"turn {k} <|im_end|>") for k in range(400)]


@pytest.mark.parametrize("piece_ids", [1, 50, 1 << 20])
def test_round_trip_of_hard_rows(spark, piece_ids):
    rows = hard_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", F.lit(1).alias("ids"), F.lit(2).alias("place"), F.lit("x").alias("plain"))
    pieces = format_conversations(frame, piece_ids=piece_ids)
    assert found(pieces) == plain(rows)
    assert (pieces.count() > 400) == (piece_ids == 1)


def test_pieces_hold_the_formatted_text_and_mask(spark):
    rows = [(1, 0, "user", "say <|im_end|> please"), (1, 1, "assistant", "<|im_end|> said"), (1, 2, "assistant", "")]
    (piece,) = format_conversations(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    ids, mask = np.frombuffer(piece.ids, "<u4"), np.unpackbits(np.frombuffer(piece.mask, np.uint8), count=piece["count"], bitorder="little")
    text = decode(ids, NAME)[0].decode()
    assert text == f"{START}user\nsay <\\|im_end|> please{END}\n{START}assistant\n<\\|im_end|> said{END}\n{START}assistant\n{END}\n"
    assert text.count(END) == 3 and list(ids).count(reserved_ids(NAME)[1]) == 3
    assert decode(ids[mask == 1], NAME)[0] == b"<\\|im_end|> said"
    assert read_piece(ids, mask, NAME)[0] == [(b"user", b"say <|im_end|> please"), (b"assistant", b"<|im_end|> said"), (b"assistant", b"")]


def test_decoding_agrees_with_the_library():
    own = encoder(NAME)
    for text in TEXTS:
        ids = own.encode_all([text])[0]
        assert decode(ids, NAME)[0].decode() == text
        if "<|endoftext|>" not in text:
            assert own.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


def test_mask_is_a_running_sum():
    a = lambda *x: np.array(x, "<u4")
    ids, mask, begins = assemble([a(1), a(2, 3), a(1)], [a(4, 5), a(6, 7, 8), a()], np.array([False, True, True]), (90, 91), a(9))
    assert ids.tolist() == [90, 1, 4, 5, 91, 9, 90, 2, 3, 6, 7, 8, 91, 9, 90, 1, 91, 9]
    assert mask.tolist() == [0] * 9 + [1] * 3 + [0] * 6 and begins.tolist() == [0, 6, 14, 18]


def test_escapes_undo():
    assert unescape(b"<\\|a<\\\\|b<|c") == b"<|a<\\|b<|c"
    assert unescape_role(b"a\\nb\\\\n<\\|") == b"a\nb\\n<|"


def test_empty_table_and_other_tokenizers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert format_conversations(empty).count() == 0
    assert conversation_digests(spark.createDataFrame([], PIECE_SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        reserved_ids("word_bpe_49k.json")
