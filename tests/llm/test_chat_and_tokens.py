import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import bpe
from ebbline.llm import chat_format as chat

TURNS = "conv_id long, turn long, role string, text string"


def expected(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return turns, learned


def run(spark, df):
    out = chat.format_chat(df)
    out = out.select("conv_id", "formatted", "loss_runs", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_runs")).alias("learned"))
    return {r.conv_id: r for r in out.collect()}


def test_format_reads_back(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\/s><\\\\/s>\\", "<<SYS>>x<</SYS>><<s>", "a\nb\r\n\n", "é🙂[INST", "[[INST]]", "\\n\\b", "$1 \\2 ${x}", "[" + "\\" * 5 + "/INST]"]
    draw = random.Random(2)
    conversations = {i: [(draw.choice(["user", "assistant", "system"]), draw.choice(nasty) + draw.choice(nasty)) for _ in range(draw.randrange(1, 7))] for i in range(60)}
    conversations[99] = [("weird\nrole\\n<|im_end|>", "x"), ("assistant", "y")]
    rows = [(i, k, r, t) for i, c in conversations.items() for k, (r, t) in enumerate(c)]
    draw.shuffle(rows)
    got = run(spark, chat.canonical_turns(spark.createDataFrame(rows, TURNS)))
    for i, c in conversations.items():
        turns, learned = expected(c)
        assert [tuple(t) for t in got[i].turns] == turns and got[i].learned == learned
        assert got[i].formatted.count(chat.START) == got[i].formatted.count(chat.END) == len(c)
        spans = [got[i].formatted[s.start : s.end] for s in got[i].loss_spans]
        assert len(spans) == sum(r == "assistant" for r, _ in c) and all(f"{chat.START}assistant\n{x}{chat.END}" in got[i].formatted for x in spans)
        assert sum(map(sum, got[i].loss_runs)) == len(got[i].formatted) and [r.learned for r in got[i].loss_runs if r.after] == [len(x) for x in spans]


def test_long_conversations(spark):
    """Many turns of one conversation, in time that grows with their number; offsets go on over blocks of turns."""
    import time

    turns = [("user" if k % 2 else "assistant", f"turn {k} " + "é🙂x" * 30) for k in range(16_000)]
    df = chat.canonical_turns(spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], TURNS))
    began = time.time()
    got = run(spark, df)[1]
    took = time.time() - began
    assert [tuple(t) for t in got.turns] == turns and got.learned == expected(turns)[1] and took < 40
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == [t for r, t in turns if r == "assistant"]
    long = "long text [INST] " * 200_000
    got = run(spark, chat.canonical_turns(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", long)], TURNS)))[1]
    assert got.learned == long and [t.text for t in got.turns] == [long, long]


def test_turn_rows_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (2, None, "human", "b"), (2, 0, "gpt", "c"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(3)).withColumn("formatted", F.lit("x"))
    got = run(spark, chat.canonical_turns(df))
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("", "x")]
    assert [tuple(t) for t in got[2].turns] == [("human", "b"), ("gpt", "c")] and got[2].learned == ""  # a row's role is its own
    assert len(got[3].turns) == 2
    assert run(spark, chat.canonical_turns(spark.createDataFrame([], TURNS))) == {}


def test_layouts_by_schema(spark):
    tables = [
        (spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"), [("user", "q"), ("assistant", "a")]),
        (spark.createDataFrame([(1, "do", "this", "done")], "conv_id long, instruction string, input string, output string"), [("user", "do\nthis"), ("assistant", "done")]),
        (spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "conv_id long, messages array<struct<role:string,content:string>>"), [("user", "q"), ("assistant", "")]),
        (spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"), [("user", "q"), ("assistant", "a")]),
    ]
    for df, want in tables:
        assert [tuple(t) for t in chat.canonical_turns(df).first().turns] == want
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, z long"))


def test_layouts_by_record(spark):
    records = [
        {"prompt": "q", "response": "a"}, {"response": "a", "prompt": "q"}, {"system": "s", "prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"question": "q", "answer": None}, {"strange": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "{")]
    got = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical_json_turns(spark.createDataFrame(rows, "i long, j string"), "i", "j").collect()}
    pair = [("user", "q"), ("assistant", "a")]
    assert got[0] == got[1] == ("prompt_response", pair)
    assert got[2] == ("system_prompt_response", [("system", "s"), *pair]) and got[3] == ("instruction_input_output", pair)
    assert got[4] == ("messages", pair) and got[5] == ("from_value", pair) and got[6] == ("question_answer", [("user", "q"), ("assistant", "")])
    assert got[7] == got[90] == got[91] == (None, [])


P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(str(P.path("word_bpe_49k.json")))


def sample_texts(library):
    draw = random.Random(0)
    letters = "abcdeaaaé'sß İΣςÀÁ\x1c!?.<|> 12²½Ⅳ漢字日本ا  \t\n🙂é'll're"
    pieces = [t.replace("</w>", "") for t in library.get_vocab()]
    pieces.sort()
    texts = [None, "", " ", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a" * 300, "aaaaaaa'sss banana bananana mississippi", "the " * 5000]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(1500)]
    return texts + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 6))) for _ in range(1500)]


def test_bpe_equals_the_library(spark, library):
    texts = sample_texts(library)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("n_tokens", F.lit("x")).withColumn("decoded", F.lit(1)).repartition(3)
    coded = bpe.bpe_encode(df, str(P.path("word_bpe_49k.json")))
    both = {r.i: r for r in bpe.bpe_decode(coded, str(P.path("word_bpe_49k.json"))).collect()}
    once = {r.i: r for r in bpe.bpe_encode(df, str(P.path("word_bpe_49k.json")), decoded_col="decoded").collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(both[i].ids, "<u4").tolist() == want and both[i].n_tokens == len(want), t
        assert both[i].decoded == once[i].decoded == library.decode(want, skip_special_tokens=False)
        assert both[i].ids == once[i].ids


def test_bpe_edges(spark, tmp_path):
    path = str(P.path("word_bpe_49k.json"))
    assert bpe.bpe_encode(spark.createDataFrame([], "i long, text string"), path).collect() == []
    got = bpe.bpe_decode(spark.createDataFrame([(1, None), (2, bytearray(b""))], "i long, ids binary"), path).collect()
    assert [r.decoded for r in got] == ["", ""]
    other = tmp_path / "other.json"
    other.write_text(json.dumps({"model": {"type": "WordLevel", "vocab": {}}}))
    with pytest.raises(ValueError):
        bpe.Model(other.read_text())


def test_bpe_prefix_states_survive_small_caches(library, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 20)
    model = bpe.Model(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = [t or "" for t in sample_texts(library)][:400]
    for t in texts:
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_are_little_endian(library):
    model = bpe.Model(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    ids = library.encode("the banana", add_special_tokens=False).ids
    assert model.encode(["the banana"])[0] == b"".join(i.to_bytes(4, "little") for i in ids) and model.decode([None, b""]).to_pylist() == ["", ""]


def read_model():
    return bpe.Model(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_bpe_asks_for_few_states(library):
    """A word's encoding asks whether two tokens may be neighbours about once per token, not once per byte."""

    class Counted(dict):
        asked = 0

        def __contains__(self, pair):
            Counted.asked += 1
            return super().__contains__(pair)

    draw, model = random.Random(4), read_model()
    pieces = sorted(t.replace("</w>", "") for t in library.get_vocab() if t.isascii() and t.replace("</w>", "").isalpha() and t.islower())
    words = sorted({"".join(draw.choice(pieces) for _ in range(3)) for _ in range(3000)})
    model._beside = Counted()
    coded = model.encode_words(words)
    assert all(np.frombuffer(coded[w], "<u4").tolist() == library.encode(w, add_special_tokens=False).ids for w in words)
    assert Counted.asked < 2 * sum(len(c) // 4 for c in coded.values())


def test_bpe_encodes_a_known_word_once(library):
    model, seen = read_model(), []
    encode_words = model.encode_words
    model.encode_words = lambda words: (seen.extend(words), encode_words(words))[1]
    texts = ["hereshor inntble", "HERESHOR!! Inntble, hereshor&&& inntble's", "(inntble) !! ,"]
    for t in texts:
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert sorted(seen) == sorted(set(seen))


def test_bpe_long_words_and_borders_of_chunks(library):
    draw, model = random.Random(5), read_model()
    stem = "".join(draw.choices("abcdeé", k=400))
    texts = [" ".join(stem[:n] + end for n in (0, 1, 15, 30, 31, 32, 33, 40, 150, 199, 200, 201, 400) for end in ("", "a", "ab", "é", "!")), "".join(draw.choices("ab", k=20_000)), "the" * 10_000]
    texts += ["é ́a ́b c 가", "Σ ΑΣ ΑΣ. ΑΣ'S", "<|endoftext|>ABC<|endoftext|> <|endoftext|>! <|EndOfText|>", "word!'s don't, x'LL! ''' a.b! ²! Ⅳ. á́! z~'` {q}", "a\x1cb!\x1fC."]
    for t in [*texts, " ".join(texts), *texts]:
        assert np.frombuffer(model.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
