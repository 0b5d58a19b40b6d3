"""Text and label expressions over columns. Token lists are as long as their own text; nothing leaves the row."""
from pyspark.sql import functions as F

from ..functions.numeric import col, hash_int
from .wordlists import (BOOLEAN_OPTIONS, LEVEL_NAMES, MEANINGFUL_FILLER, NEUTRAL_PHRASES, PSEUDO_WORDS, RELATION_FILLERS, STOPWORDS,
                        STRUCTURED_PREFIX, TOKEN_PATTERN, WORDY_FILLER, WORDY_MIN_EXTRA, WORDY_PREFIX, WORDY_SUFFIX)


def words(values):
    return F.array(*[F.lit(v) for v in values])


def normalize_text(t):
    return F.trim(F.regexp_replace(F.lower(col(t)), "[^a-z0-9]+", " "))


def tokens(t):
    """Lower-case word tokens of the whole text."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), lambda w: F.lower(w))


def without(toks, stop):
    return F.filter(toks, lambda w: ~w.isin(*stop))


def content_words(t):
    return without(tokens(t), STOPWORDS)


def content_word_count(t):
    return F.size(content_words(t))


def answer_label(raw, options, labels):
    """Option label of a raw answer: letter, then 0-based index, then 1-based, then exact or normalised text."""
    v = F.trim(col(raw).cast("string"))
    opts, labs = col(options), col(labels)
    n = F.size(labs)
    idx = F.when(v.rlike("^[0-9]+$"), v.try_cast("int"))
    by_index = F.when((idx >= 0) & (idx < n), F.try_element_at(labs, idx + 1)).when(idx == n, F.try_element_at(labs, n))
    norm = normalize_text(v)
    hit = F.filter(labs, lambda l: (F.try_element_at(opts, l) == v) | (normalize_text(F.try_element_at(opts, l)) == norm))
    letter = F.when((F.length(v) == 1) & F.array_contains(labs, F.upper(v)), F.upper(v))
    return F.when(v.isNotNull() & (v != ""), F.coalesce(letter, by_index, F.try_element_at(hit, F.lit(1))))


def yes_no_labels(options):
    """(yes label, no label): the last option whose normalised text is yes / no."""
    def last(word):
        e = F.filter(F.map_entries(col(options)), lambda kv: normalize_text(kv["value"]) == word)
        return F.try_element_at(e, F.lit(-1))["key"]
    return last("yes"), last("no")


def label_to_yes_no(label, options):
    norm = normalize_text(F.coalesce(F.try_element_at(col(options), col(label)), col(label)))
    return F.when(norm == "yes", "Yes").when(norm == "no", "No")


def yes_no_margin(scores, yes, no):
    return F.try_element_at(col(scores), col(yes)) - F.try_element_at(col(scores), col(no))


def parse_options(raw):
    """Non-empty strings of a literal list, tuple or dict such as ['a', "b", None, True,]; bad input gives an empty array."""
    text = F.regexp_replace(F.trim(col(raw)), r"(?s)^\((.*)\)$", "[$1]")
    text = F.regexp_replace(text, r",\s*([\]}])$", "$1")
    for word, value in (("None", "null"), ("True", '"True"'), ("False", '"False"')):   # bare words, not those inside quotes
        quoted = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
        text = F.regexp_replace(text, rf"\G((?:[^'\"{word[0]}]|{quoted}|{word[0]}(?!{word[1:]}\b))*+){word}\b", "$1" + value)
    parsed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})
    as_map = F.map_values(F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true"}))
    vals = F.coalesce(F.when(text.startswith("["), parsed), F.when(text.startswith("{"), as_map), F.array().cast("array<string>"))
    return F.filter(F.transform(vals, lambda o: F.trim(o)), lambda o: o.isNotNull() & (o != ""))


def letter_labels(options):
    return F.transform(options, lambda o, i: F.char(F.lit(65) + i))


def atoms(kind, names):
    """Prefixed content tokens of every name; relation tokens are joined by _ without fillers."""
    if kind == "relation":
        parts = F.transform(names, lambda n: F.array_join(without(tokens(n), RELATION_FILLERS), "_"))
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit("relation:"), p))
    if kind == "op":
        ops = F.transform(names, lambda n: F.lower(F.trim(n)))
        return F.transform(F.filter(ops, lambda p: p != ""), lambda p: F.concat(F.lit("op:"), p))
    flat = F.flatten(F.transform(names, lambda n: without(tokens(n), STOPWORDS)))
    return F.transform(flat, lambda p: F.concat(F.lit(kind + ":"), p))


def option_atoms(options):
    return F.flatten(F.transform(options, lambda o: without(tokens(o), STOPWORDS + BOOLEAN_OPTIONS)))


def semantic_complexity(entities, attributes, relations, ops, depth, candidates):
    """Entities + attributes + relations + operators + depth + log1p(candidates), negatives floored."""
    live_ops = F.size(F.filter(ops, lambda o: F.trim(o) != ""))
    return (F.size(entities) + F.size(attributes) + F.size(relations) + live_ops
            + F.greatest(col(depth).cast("double"), F.lit(0.0)) + F.log1p(F.greatest(col(candidates).cast("double"), F.lit(0.0))))


def cycle(vocab, n):
    """n words of a fixed list, cycled; empty for n <= 0."""
    v = words(vocab)
    seq = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.when(n > 0, F.array_join(F.transform(seq, lambda i: F.element_at(v, ((i - 1) % len(vocab)) + 1)), " ")).otherwise("")


def wordify(question, base_count):
    """Prefix + question + suffix, padded with cycled filler words to the base count plus the minimum extra."""
    base = F.trim(col(question))
    cand = F.trim(F.regexp_replace(F.concat(F.lit(WORDY_PREFIX), base, F.lit(" " + WORDY_SUFFIX)), r"\s+", " "))
    need = col(base_count) + WORDY_MIN_EXTRA - content_word_count(cand)
    return F.when(base == "", base).when(need <= 0, cand).otherwise(F.concat(cand, F.lit(" "), cycle(WORDY_FILLER, need), F.lit(".")))


def refreshed_load(score, sem_score, load, question, n_atoms):
    """Keep given semantics; fall back to the text's content words where nothing is given."""
    has = (col(score) > 0) | (col(sem_score) > 0) | (col(load) > 0) | (col(n_atoms) > 0)
    return F.when(has, col(score)).otherwise(content_word_count(question).cast("double"))


def family_name(name):
    """Perturbation family: cut at |sev, then at (, trimmed, 'unknown' if empty."""
    cut = F.trim(F.substring_index(F.substring_index(F.coalesce(col(name), F.lit("")), "|sev", 1), "(", 1))
    return F.when(cut == "", "unknown").otherwise(cut)


def parse_severity(key):
    """(name, N) of name|sevN; both null if malformed."""
    n = F.regexp_extract(col(key), r"^(.*)\|sev([+-]?[0-9]+)$", 2).try_cast("int")
    return F.when(n.isNotNull(), F.regexp_extract(col(key), r"^(.*)\|sev([+-]?[0-9]+)$", 1)), n


def family_group(family, kind, mode, split=False):
    """natural, low/high frequency (split by keep / noise on request), else the family itself."""
    f, k, m = col(family), col(kind), col(mode)
    if split:
        freq = (F.when(k == "fft_keep", F.when(m == "low", "lowfreq_keep").otherwise("highfreq_keep"))
                .otherwise(F.when(m == "low", "lowfreq_noise").when(m == "high", "highfreq_noise").otherwise("allfreq_noise")))
    else:
        freq = F.when(m == "low", "lowfreq").otherwise("highfreq")
    return F.when(f == "natural", "natural").when(f == "frequency", freq).otherwise(f)


def safe_filename(t, limit=120):
    c = F.regexp_replace(F.regexp_replace(col(t), "[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(c == "", "item").otherwise(F.left(c, F.lit(limit)))


def safe_stem(t):
    c = F.regexp_replace(F.regexp_replace(col(t), "[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.when(c == "", "image").otherwise(c)


# fixed values: wording of the rendered prompts by style
PROMPT_HEAD = {"mcq": "Options:", "open_with_options": "Options (for your reference; answer freely):"}
PROMPT_TAIL = {"mcq": "Please select the correct answer from the options above.", "open": "Please answer the question concisely.",
               "open_with_options": "Provide the best answer in your own words."}
YES_NO_TAIL = "Answer with exactly one word: Yes or No."


def render_prompt(style, hint, question, options):
    """Prompt text of an item. `options` is an array of (label, text) in order."""
    q = F.concat(F.lit("Question: "), col(question))
    if style == "yes_no":
        return F.concat(F.lit("Question: "), F.trim(col(question)), F.lit("\n" + YES_NO_TAIL))
    h = F.when(col(hint).isNotNull() & (col(hint) != ""), F.concat(F.lit("Hint: "), col(hint)))
    if style == "open":
        return F.concat_ws("\n", h, q, F.lit(PROMPT_TAIL["open"]))
    lines = F.transform(col(options), lambda o: F.concat(o["label"], F.lit(". "), o["text"]))
    has = F.size(col(options)) > 0
    tail = F.when(has, PROMPT_TAIL[style]).otherwise(PROMPT_TAIL["open"]) if style == "mcq" else F.lit(PROMPT_TAIL[style])
    return F.concat_ws("\n", h, q, F.when(has, F.concat_ws("\n", F.lit(PROMPT_HEAD[style]), F.array_join(lines, "\n"))), tail)


def template_variants(question, wordy, seed_key):
    """Five prompt templates as an array of (template, question)."""
    q, w = col(question), F.coalesce(col(wordy), col(question))
    target = F.greatest(content_word_count(w), content_word_count(q))
    prefix = cycle(MEANINGFUL_FILLER, target - content_word_count(q))
    ranked = F.array_sort(F.transform(words(NEUTRAL_PHRASES), lambda p: F.struct(F.md5(F.concat_ws("|", col(seed_key).cast("string"), p)).alias("h"), p.alias("p"))))
    neutral = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["p"]), " ")
    rows = (("original_primary", q), ("current_wordy_mirror", w), ("random_neutral_wrapper", F.concat_ws(" ", neutral, q)),
            ("meaningful_same_content_count", F.when(prefix == "", q).otherwise(F.concat(prefix, F.lit(". "), q))),
            ("structured_instruction", F.concat(F.lit(STRUCTURED_PREFIX), q)))
    return F.array(*[F.struct(F.lit(n).alias("template"), t.alias("text")) for n, t in rows])


def part_level(name):
    """Level by underscore depth: whole object, part, subpart."""
    n = F.size(F.split(col(name), "_"))
    return F.when(n == 1, LEVEL_NAMES[0]).when(n == 2, LEVEL_NAMES[1]).otherwise(LEVEL_NAMES[2])


def part_prompt(name):
    parts = F.filter(F.split(F.regexp_replace(col(name), "_", " "), r"\s+"), lambda p: p != "")
    chain = F.array_join(F.concat(F.reverse(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), F.slice(parts, 1, 1)), " of the ")
    return F.when(F.size(parts) == 0, "segment the object").otherwise(F.concat(F.lit("segment the "), chain))


def is_yes_no(options):
    vals = F.array_sort(F.array_distinct(F.transform(col(options), lambda o: F.lower(F.trim(o)))))
    return vals == F.array(F.lit("no"), F.lit("yes"))


def overlay_phrases(labels, base_label, limit=3):
    wrong = F.slice(F.filter(col(labels), lambda x: x != col(base_label)), 1, limit)
    default = words(["Answer is B", "Answer is C", "Answer is D"])
    return F.when(F.size(wrong) > 0, F.transform(wrong, lambda x: F.concat(F.lit("Answer is "), x))).otherwise(default)


def model_size(model_id):
    base = F.element_at(F.split(col(model_id), "/"), -1)
    num = F.regexp_replace(F.regexp_extract(base, r"([0-9]+(?:\.[0-9]+)?)([bBmM])", 1), r"\.", "p")
    return F.concat(num, F.upper(F.regexp_extract(base, r"([0-9]+(?:\.[0-9]+)?)([bBmM])", 2)))


def level_order(name):
    """Position of a rung name; unknown names sort last."""
    pos = F.array_position(words(LEVEL_NAMES), col(name))
    return F.when(pos > 0, pos - 1).otherwise(len(LEVEL_NAMES)).cast("int")


def infer_from_path(config_value, path, needles):
    """The configured value, else the tag of the first needle found in the lower-case path, else ''."""
    p = F.lower(col(path))
    guess = F.lit("")
    for needle, tag in reversed(needles):
        guess = F.when(F.contains(p, F.lit(needle)), tag).otherwise(guess)
    return F.when(col(config_value).isNotNull() & (col(config_value) != ""), col(config_value)).otherwise(guess)


def effect_label(d):
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def correlation_label(r):
    a = F.abs(r)
    return F.when(a < 0.3, "weak").when(a < 0.7, "moderate").otherwise("strong")


def control_prompt(prompt, control, seed, key):
    """'.' for the empty control, else pseudo-words as many as the prompt has tokens (at least four)."""
    n = F.greatest(F.size(F.filter(F.split(F.regexp_replace(col(prompt), "\n", " "), " "), lambda t: t != "")), F.lit(4))
    v = words(PSEUDO_WORDS)
    rand = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(v, (hash_int(seed, key, i) % len(PSEUDO_WORDS)).cast("int") + 1)), " ")
    return F.when(col(control) == "empty_language", ".").otherwise(rand)
