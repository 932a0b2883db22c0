"""Small tables with all that an operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, rank long, node string, low long, key string"
WORDS = ["the", "of", "and", "Tion", "ing", "übel", "für", "naïve", "Ähre", "x1", "2024", "日本", "😀a"]


def prose(rng, n_lines=6, n_words=14):
    return "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["", "", "e", "an", "os", "."]) for _ in range(n_words)) for _ in range(n_lines))


def documents(seed=3, n=40):
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 9)) for _ in range(n)]
    passage = prose(rng, 4)
    for i in range(0, n, 4):
        texts[i] = texts[i] + "\n" + passage + "\n" + texts[(i + 5) % n]
    texts[3] = texts[1]
    words = texts[8].split(" ")
    words[len(words) // 2] = "changed"
    texts[9] = " ".join(words)
    texts[10] = "one line\n" * 30
    texts[11] = prose(rng, 300)
    texts[12] = "ab" * 500
    texts += [None, "", " \t\n ", "Word", "a b c", "\n\n\n", "é" * 120, texts[11][2000:9000]]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, 1, 2, 3, "n", 4, "k") for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append(rows[0])
    rows.append((None, texts[2], "en", "s1", 1, 1, 2, 3, "n", 4, "k"))
    rng.shuffle(rows)
    return rows
