import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from trackweave.llm.bpe import Encoder

ODD = ["", " ", "a", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|>!!", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ﬁ", "é ẛ̣", "a\x1c\x1db\x85c d e​f",
       "it's WE'LL 'S '' 12345 ½ Ⅷ ٣", "q" * 5000, "ab" * 3000 + " " + "é" * 700, "日本語テキスト 🙂👍🏽", "\x00\x01", "<|endoftext|", "don’t—stop…", "'sx 'rex", "İİ"]


def check(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t[:80]
        assert own.both(t)[1] == lib.decode(ids, skip_special_tokens=False)


def test_odd_texts():
    check(ODD)


def test_documents():
    check(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist())


def test_heap_equals_scan():
    own = Encoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for w in ("thethingthe" * 30, "aaaa" * 60, "ononion" * 20):
        parts = [own.inner[b] for b in w.encode()]
        assert own.long(list(parts)) == own.short(list(parts))
