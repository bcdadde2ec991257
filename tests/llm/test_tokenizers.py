import hashlib
import random

import edge
import pyarrow as pa
import sentencepiece

from tankwise.llm import piece_codec, token_counts
from tankwise.llm.merge_vocab import load

PATH = piece_codec.vocabulary_path(piece_codec.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(text):
    ids = SP.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(SP.decode(ids).encode()).hexdigest())


def odd_texts():
    rng = random.Random(1)
    texts = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c\t d\r\n\n e", "▁x ▁▁ y", "日本語のテキスト", "🙂🙃‍",
             "x" * 5000, "ab" * 900 + " " * 40 + "q", "\x00\x01", "é é", "<s> </s> <unk> <0x0A>", "a b　c"]
    texts += ["".join(rng.choice(" ab▁\n\té日🙂xyzthe") for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += ["".join(rng.choice(["the", "in", "er", "an", "stand", "ing", "tion", "x", "function", "return"])
                      for _ in range(rng.randint(1, 400))) for _ in range(60)]
    return texts


def test_encoding_equals_the_library():
    texts = odd_texts()
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    rows = [r for out in piece_codec._encode([batch], PATH, True) for r in out.to_pylist()]
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows] == [want(t) for t in texts]


def test_counts_equal_the_library():
    texts = odd_texts()
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    rows = [r for out in token_counts._count([batch], PATH, 50) for r in out.to_pylist()]
    n = [len(SP.encode(t or "")) for t in texts]
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows] == \
        [(len((t or "").encode()), k, k > 50) for t, k in zip(texts, n)]


def test_chunk_maps_compose_to_the_whole_run():
    m = token_counts.Transducer(load(PATH))
    rng = random.Random(5)
    for n in (1, 127, 128, 129, 700, 3000):
        text = "▁" + "".join(rng.choice("abcdeéthin日") for _ in range(n))
        assert m.run_chunks(text) == m.run(text)[1] == len(SP.encode(text[1:]))


def test_heap_and_array_agendas_agree(monkeypatch):
    vocab = load(PATH)
    words = [t.replace(" ", "▁").replace("\n", "") for t in odd_texts() if t]
    one = piece_codec.agenda(vocab, words)
    monkeypatch.setattr(piece_codec, "HEAP_FROM", 2)
    assert piece_codec.agenda(vocab, words) == one


def test_a_wrong_segment_raises():
    vocab = load(PATH)
    try:
        piece_codec.check_segments(vocab, [" the"], [[5, 6]])
    except ValueError:
        return
    raise AssertionError("not noticed")


def test_tables(spark):
    docs = edge.documents(spark)
    for op in (piece_codec.piece_codec, token_counts.token_counts):
        rows = op(docs, PATH).collect()
        assert len(rows) == len(edge.TEXTS)
        have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows)
        assert have == sorted((i is None, i or 0, want(t)[0]) for i, t in edge.TEXTS)
        assert op(edge.nothing(spark), PATH).count() == 0
