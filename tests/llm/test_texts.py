import random

import numpy as np
import pytest

from veilframe.llm import crf
from veilframe.llm.entities import PLACEHOLDERS, Tagger, aligned_form, fit, mask
from veilframe.llm.variants import latin, variants
from veilframe.llm.languages import edges_of, forward, normal_label, segments_of
from veilframe.llm.lookalikes import consistent_form, fold_text, lookalike_pairs


@pytest.mark.parametrize(("a", "b"), [("Гдe мoя пoсылкa", "Где моя посылка"), ("щё й", "щё й"), ("ＡＲ１２", "AR12"), ("а б", "а б"), ("те­кст​", "текст"), ("Τag", "Tag"), ("ТХ12", "TX12")])
def test_equal_looks(a, b):
    assert consistent_form(a) == consistent_form(b)
    assert consistent_form(consistent_form(a)) == consistent_form(a)


@pytest.mark.parametrize(("a", "b"), [("ёж", "еж"), ("а  б", "а б"), ("А", "а"), ("а–б", "а-б"), ("№5", "No5"), ("👨‍👩", "👨👩")])
def test_visible_differences_stay(a, b):
    assert consistent_form(a) != consistent_form(b)


def test_lookalike_pairs(spark):
    rows = [(1, "дом"), (2, "дoм"), (3, "дом"), (3, "дом"), (4, None), (5, ""), (6, "​"), (7, "Дом"), (8, "д​ом")]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {(r["id_a"], r["id_b"]) for r in lookalike_pairs(df, "id", "content").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert lookalike_pairs(df.limit(0), "id", "content").count() == 0
    assert fold_text(None) == "" and consistent_form(None) is None


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "a", "b", "▁a", "ab", "▁ab", "ba"])}
    theta = np.random.default_rng(0).dirichlet(np.ones(len(vocab) + 1), 2).T

    def brute(t, k):
        if not t:
            return 1.0
        return sum(theta[vocab[t[:n]], k] * brute(t[n:], k) for n in range(1, len(t) + 1) if t[:n] in vocab)

    words = ["ab", "aba", "b", "abab"]
    logp, _ = forward(edges_of(words, vocab), theta)
    for i, w in enumerate(words):
        for k in range(2):
            assert abs(np.exp(logp[i, k]) - brute("▁" + w, k)) < 1e-12
    eps = 1e-6  # expected counts are derivatives
    counts = np.array([[2.0, 1.0], [0.0, 3.0], [1.0, 0.0], [1.0, 1.0]])
    _, got = forward(edges_of(words, vocab), theta, counts)
    for p in (1, 4):
        up = theta.copy()
        up[p, 0] *= 1 + eps
        d = (counts[:, 0] * (forward(edges_of(words, vocab), up)[0] - logp)[:, 0]).sum() / eps
        assert abs(d - got[p, 0]) < 1e-4


def test_labels_and_segments():
    codes = {"ru": "ru", "rus": "ru", "russian": "ru"}
    assert [normal_label(x, codes) for x in ("RU", "rus", "ru_RU", "ru-RU", "und", "", None, "xx")] == ["ru"] * 4 + [None] * 4
    t = "Подписал В.Т. Иванов. Дальше ещё.\nСтрока"
    assert [t[a:b] for a, b in segments_of(t)] == ["Подписал В.Т. Иванов.", "Дальше ещё.", "Строка"]


def test_chain_agrees_with_enumeration():
    rng = np.random.default_rng(0)
    u, tr, st = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    mask_ = np.ones((1, 4), dtype=bool)
    node, _, z = crf.marginals(u, mask_, tr, st)
    paths = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    s = np.array([st[p[0]] + sum(u[0, i, p[i]] for i in range(4)) + sum(tr[p[i], p[i + 1]] for i in range(3)) for p in paths])
    assert abs(np.log(np.exp(s).sum()) - z[0]) < 1e-9
    w = np.exp(s - z[0])
    for i in range(4):
        for k in range(3):
            assert abs(node[0, i, k] - sum(x for x, p in zip(w, paths) if p[i] == k)) < 1e-9
    assert tuple(crf.viterbi(u, mask_, tr, st)[0]) == paths[int(s.argmax())]


def test_skip_links_carry_a_label_over():
    labels = ["O", "B-A", "I-A"]
    emit = np.zeros((4, 3))
    emit[1, 1], emit[2, 0], emit[3, 0] = 3.0, 2.0, 0.4
    m = crf.CRF(labels, emit, np.zeros((3, 3)), np.zeros(3), 2.0)
    feats = [np.array([[1], [2], [3]])]
    assert list(crf.decode(m, feats, [[]])[0]) == [1, 0, 0]
    assert list(crf.decode(m, feats, [[(0, 2)]])[0])[2] in (1, 2)


def records(n: int, seed: int):
    """Labelled records put together from parts, as a labelled table would give them."""
    r = random.Random(seed)
    given, sur = ("Анна", "Пётр", "Мария", "Олег", "Софья", "Тимур"), ("Соколов", "Зимин", "Орлов", "Громов", "Лужин")
    out = []
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    for _ in range(n):
        g, f = r.choice(given), r.choice(sur)
        name = f"{g} {f}{'а' if g[-1] in 'ая' else ''}"
        kinds = {
            "PERSON": ("меня зовут", name), "PHONE_NUMBER": ("телефон", r.choice((f"+79{digits(9)}", f"8 9{digits(2)} {digits(3)}-{digits(2)}-{digits(2)}"))), "EMAIL_ADDRESS": ("почта", f"{latin(f.lower())}{digits(2)}@mail.test"),
            "INN": ("ИНН", digits(r.choice((10, 12)))), "SNILS": ("СНИЛС", f"{digits(3)}-{digits(3)}-{digits(3)} {digits(2)}"), "PASSPORT": ("паспорт", f"{digits(4)} {digits(6)}"),
            "DATE_OF_BIRTH": ("дата рождения", f"{r.randint(10, 28)}.0{r.randint(1, 9)}.19{r.randint(40, 99)}"), "CREDIT_CARD": ("карта", " ".join(digits(4) for _ in range(4))), "ADDRESS": ("по адресу", f"ул. Садовая, д. {r.randint(1, 90)}, кв. {r.randint(1, 90)}"),
        }
        text, spans = f"Прошу сверить заказ {digits(7)} марки Вектор", []
        for k in r.sample(sorted(kinds), 2):
            text += f", {kinds[k][0]} "
            spans.append((len(text), len(text) + len(kinds[k][1]), k))
            text += kinds[k][1]
        out.append((text + r.choice((".", "!", ", ждём ответа отдела Север")), spans))
        out.append((f"Накладная {digits(7)} компании Вектор не найдена, склад Заречье ждёт {digits(3)} коробок.", []))
    return out


@pytest.fixture(scope="module")
def tagger() -> Tagger:
    return fit(records(150, 1))


def test_held_out_records_are_found_whole(tagger):
    held = records(100, 2)
    wrong = sum(got != spans for got, (_, spans) in zip(tagger.tag([t for t, _ in held]), held))
    assert wrong <= 0.03 * len(held)
    assert {t for _, s in held for _, _, t in s} == set(PLACEHOLDERS)


def test_variants_are_sound_and_repeatable():
    ex = records(60, 3)
    v = variants(ex, 400)
    assert v == variants(ex, 400) and variants([], 10) == []
    for text, spans in v:
        assert all(0 <= a < b <= len(text) and text[a:b].strip() for a, b, _ in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert {t for _, s in v for _, _, t in s} == set(PLACEHOLDERS)


def test_like_words_are_tied_over_a_long_text(tagger):
    """The last sentence alone says nothing of the word; its first occurrence, over 400 tokens before, does."""
    far = "слово " * 450
    assert tagger.model.skip > 0
    text = f"меня зовут Тимур Громов. {far}. Громов"
    assert [text[a:b] for a, b, _ in tagger.tag([text])[0]] == ["Тимур Громов", "Громов"]


def test_dates_and_numbers_of_other_kinds_are_left(tagger):
    for t in ("договор от 14.03.2021", "Доставка перенесена на 02.11.2024.", "заказ 12 34 567890 отменён", "магазин «Анна» закрыт"):
        assert tagger.tag([t])[0] == [], t


def test_masks_leave_the_rest_unchanged(tagger):
    text = "Почта ivan@mail.test, тел​ефон +7 999 123-45-67 👍"
    spans = tagger.tag([text])[0]
    assert mask(text, spans) == "Почта <EMAIL>, тел​ефон <PHONE> 👍"
    assert tagger.tag(["", None, " ", "x" * 20000, "слово " * 5000])[:3] == [[], [], []]
    form, where = aligned_form("й й a​b")
    assert form == "й й ab" and len(where) == len(form)


def test_texts_of_look_alike_letters_only_have_one_form():
    assert consistent_form("OK") == consistent_form("ОК") == consistent_form(consistent_form("OK"))
    assert consistent_form("OK, see you") == "OK, see you" and consistent_form("12 + 3") == "12 + 3"
