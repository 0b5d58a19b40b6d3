"""Fixed vocabularies. Their values must equal the ones the published results were made with."""

# fixed values: words that do not count as prompt content
STOPWORDS = ("a", "an", "the", "this", "that", "these", "those", "is", "are", "was", "were", "there", "what", "which",
             "who", "whom", "whose", "image", "picture", "photo", "of")
# fixed values: option texts and relation words that carry no atom
BOOLEAN_OPTIONS = ("yes", "no", "true", "false")
RELATION_FILLERS = ("a", "an", "the", "to", "of", "is", "are")
# fixed value: the token pattern
TOKEN_PATTERN = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"

# fixed values: attribute vocabulary by category, in order
ATTRIBUTE_CATEGORIES = {
    "color": ("white", "black", "red", "blue", "green", "yellow", "brown", "gray", "grey", "orange", "pink", "purple",
              "beige", "tan", "silver", "gold"),
    "material": ("wooden", "metal", "plastic", "glass", "leather", "fabric", "concrete", "brick", "stone", "ceramic", "rubber"),
    "shape": ("round", "square", "rectangular", "circular", "oval", "triangular", "flat", "curved"),
    "size": ("large", "small", "big", "little", "tall", "short", "long", "thin"),
    "texture": ("striped", "spotted", "plaid", "checkered", "smooth", "rough", "shiny", "matte"),
}
# fixed values: relations with a provably false opposite
OPPOSITE_RELATION = {
    "to the left of": "to the right of", "to the right of": "to the left of", "above": "below", "below": "above",
    "behind": "in front of", "in front of": "behind", "on top of": "under", "under": "on top of",
}

IDENTIFYING_ORDER = ("color", "shape", "material", "size")

# fixed values: wording of the wordy mirror prompts
WORDY_PREFIX = "Please read the following question carefully and answer the same question directly. "
WORDY_SUFFIX = "The extra wording is only polite framing and should not change what you are being asked to answer."
WORDY_FILLER = ("context", "review", "observation", "perspective", "analysis", "instance", "scene", "visual", "careful",
                "straightforward", "response", "neutral", "polite", "steady", "focused", "general", "supportive",
                "ordinary", "plain", "background")
WORDY_MIN_EXTRA = 12

# fixed values: wording of the prompt templates
MEANINGFUL_FILLER = ("carefully", "inspect", "visible", "objects", "attributes", "spatial", "relations", "scene", "evidence",
                     "before", "answering", "focus", "on", "grounded", "visual", "details", "compare", "relevant", "regions",
                     "avoid", "assumptions", "use", "observable", "information")
NEUTRAL_PHRASES = (
    "For this visual checkpoint, continue with the neutral inspection step.",
    "Before the final response, maintain the same image context and proceed.",
    "This wording adds no new scene facts; treat it only as instruction padding.",
    "Keep the visual instance fixed while answering the following item.",
    "Move through the prompt carefully and rely only on the displayed image.",
)
STRUCTURED_PREFIX = ("Visual evidence check. Read the item, inspect the image, and answer with the most appropriate "
                     "option. Question: ")
# fixed values: pseudo-words of the random control prompt
PSEUDO_WORDS = ("kava", "lorn", "mep", "silar", "torin", "vexa", "drim", "palo", "nure", "cesta", "brin", "zalor", "tiven",
                "mora", "quess")
# fixed values: words that make a card easier or harder to read, with their weights
INTERPRETABLE_WORDS = ("tree", "building", "bus", "dog", "cat", "boat", "sign", "shirt", "car", "train", "airplane", "table",
                       "flower", "leaves")
ODD_WORDS = ("mouth", "hair", "feet", "ear", "eye", "neck", "toilet paper", "foil")
# fixed values: display order of the perturbation types in imported summaries
SUMMARY_TYPES = ("Translation", "Pad/Crop", "Scale", "Scale+Pad", "Rotation", "TextOverlay", "Any")
# fixed values: names of the eight rungs, in order
LEVEL_NAMES = ("L1_COARSE", "L2_MEDIUM", "L3_FINE", "L4_VERY_FINE", "L5_WORDY_SIMPLETON", "L6_WORDY_MEDIUM",
               "L7_WORDY_FINE", "L8_WORDY_VERY_FINE")


def attribute_category():
    """attribute word -> category."""
    return {w: c for c, words in ATTRIBUTE_CATEGORIES.items() for w in words}
