"""Word lists and limits. Results depend on them."""

from __future__ import annotations

# Sentences
MIN_SENTENCE_CHARS, MAX_SENTENCE_CHARS = 25, 600
MIN_SENTENCE_WORDS = 5
MIN_ALPHA_SHARE = 0.5

# Keywords
CONTENT_POS = ("NOUN", "PROPN", "ADJ")
MIN_TERM_CHARS = 3
MAX_PHRASE_TOKENS = 3
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those")
ARTICLES = ("a", "an", "the")
DOMAIN_FILLER = (
    "example", "examples", "figure", "figures", "table", "tables", "chapter", "section", "page", "pages",
    "following", "given", "used", "using", "use", "way", "ways", "thing", "things", "case", "cases",
    "time", "times", "number", "numbers", "value", "values", "part", "parts", "type", "types",
    "kind", "kinds", "form", "forms", "term", "terms", "word", "words", "point", "points",
    "note", "notes", "order", "result", "results", "problem", "problems", "idea", "ideas", "fact", "facts", "lot", "lots",
)
FILLER_LINKS = ("of", "and", "in", "for")

# Corpus
MIN_DOCUMENTS_FOR_IDF = 5
COLD_START_IDF = 0.7

# Sentence ranking
DAMPING = 0.85
TOLERANCE = 1e-4
MAX_ITERATIONS = 100
GRAPH_MIN_SENTENCES = 10

# Definitions
MAX_TERM_WORDS = 6
MAX_TERM_CHARS = 60
MIN_DEFINITION_CHARS, MAX_DEFINITION_CHARS = 12, 320
CUE_PHRASES = (("define", "as"), ("refer", "to"), ("know", "as"), ("call",), ("mean",), ("denote",), ("describe", "as"), ("term", "as"), ("represent",))
COPULAS = ("be", "become", "remain", "seem", "appear")
HYPERNYM_MARKERS = ("type of", "kind of", "form of", "class of", "subset of", "example of", "instance of")
TRAILING_WORDS = ("and", "or", "of", "in", "with")
BAD_TERMS = (
    "this", "that", "these", "those", "it", "they", "there", "here", "which", "who", "what", "one", "ones",
    "such", "another", "other", "others", "he", "she", "we", "you", "i", "them", "him", "her", "us",
    "some", "many", "most", "all", "both", "each", "either", "neither", "few", "several",
)
EXCLUDED_FROM_PHRASE = ("mark", "appos", "cc")
MODALS = ("could", "would", "might", "may", "must", "should", "can", "shall")
CONTRASTIVE = ("another", "other", "others", "different", "similar", "same")
EXPLETIVE_SUBJECTS = ("there", "it", "this", "that", "these", "those", "here")
PATTERN_BASE = {"cue": 0.75, "copular": 0.6, "hypernym": 0.6, "appos": 0.45}

# Facts
PROPERTY_NOUNS = (
    "complexity", "size", "length", "capacity", "cost", "advantage", "disadvantage", "drawback", "benefit",
    "property", "characteristic", "feature", "requirement", "precondition", "invariant", "bound", "limit",
    "height", "depth", "degree", "weight", "value", "structure", "form", "representation", "purpose", "role",
    "behaviour", "behavior",
)
COMPOSITION_VERBS = ("consist", "comprise", "compose")
COMPOSITION_PREPS = ("of", "in")
POSSESSION_VERBS = ("have", "contain", "include", "hold", "offer", "provide", "require", "support")
PURPOSE_VERBS = ("use", "employ", "apply")
ENABLING_VERBS = ("allow", "enable", "permit", "let")
COMPARISON_NOUNS = ("difference", "distinction", "comparison", "contrast")
DIFFERS_VERBS = ("differ", "vary")
UNLIKE_MARKERS = ("unlike", "contrary")
USEFUL_ADJECTIVES = ("useful", "helpful", "needed", "required", "essential", "important", "necessary")
PROCEDURAL_VERBS = ("begin", "start", "proceed", "work")
ORDERING_ADVERBS = ("first", "firstly", "then", "next", "finally", "lastly", "subsequently", "afterwards")
TEMPORAL_MARKS = ("when", "whenever", "after", "before", "once")
UNRESOLVED_PRONOUNS = ("it", "its", "they", "them", "their", "this", "that", "these", "those", "he", "she")
MIN_FACT_CONFIDENCE = 0.50
MIN_FACT_CHARS = 12
PREDICATE_DROP = ("mark", "cc", "conj", "advcl", "relcl", "acl", "csubj")
PARTICIPANT_DROP = ("prep", "conj", "cc", "mark", "relcl", "acl", "advcl")
FAMILY = {
    "consist_of": "PROPERTY", "possess_property": "PROPERTY", "possess_salient": "PROPERTY", "be_of": "PROPERTY",
    "difference_between": "COMPARISON", "differ_from": "COMPARISON", "unlike": "COMPARISON", "comparative_than": "COMPARISON",
    "used_to_xcomp": "PURPOSE", "used_for": "PURPOSE", "useful_for": "PURPOSE", "enable": "PURPOSE",
    "begin_by": "PROCESS", "ordered_chain": "PROCESS", "temporal_advcl": "PROCESS",
}
FACT_BASE = {
    "consist_of": 0.65, "possess_property": 0.50, "possess_salient": 0.35, "be_of": 0.55,
    "difference_between": 0.65, "differ_from": 0.65, "unlike": 0.65, "comparative_than": 0.50,
    "used_to_xcomp": 0.60, "used_for": 0.60, "useful_for": 0.45, "enable": 0.40,
    "begin_by": 0.60, "ordered_chain": 0.50, "temporal_advcl": 0.40,
}

# Cards
VERSUS = "vs."
FAMILY_LABELS = {"DEFINITION": "definition", "PROPERTY": "properties", "PROCESS": "how it works", "COMPARISON": "compared", "PURPOSE": "purpose"}
MAX_PER_TERM, MAX_PER_STRONG_TERM, STRONG_CONFIDENCE = 2, 3, 0.70
FACT_FLOOR, FACT_SHARE = 3, 0.5

# Cloze
BLANK = "_____"
MIN_BLANK_CHARS = 4
MAX_BLANK_SHARE = 0.6

# Quiz and distractors
MIN_QUIZ_CONFIDENCE = 0.55
MAX_QUIZ_DEFINITIONS = 12
DISTRACTORS = 3
MIN_DISTRACTOR_CHARS = 15
BAND_LOW, BAND_HIGH = 0.12, 0.72
PREFIX_SIMILAR, PREFIX_DIFFERENT = 0.3, 0.2
MAX_SIBLINGS = 200

# Options: default, least, most
OPTION_RANGES = {"max_cards": (25, 1, 200), "max_quiz_questions": (10, 0, 100), "max_keywords": (20, 1, 100), "max_summary_sentences": (5, 1, 50)}
MAX_TEXT_CHARS = 500_000
MAX_TITLE_CHARS = 300

# Callbacks
WEBHOOK_ATTEMPTS = 3
WEBHOOK_BACKOFF = (0.5, 2.0, 5.0)
WEBHOOK_TIMEOUT = 15.0

#: Our own list of words that carry no topic.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each either few first for from further had has have having he her here hers him his how i if in into is it its itself just last may me might more most must my neither no nor not now of off on once only or other our out over own same shall she should so some such than that the their them then there these they this those through to too top under until up upon us very was we were what when where which while who whom whose why will with would you your"
).split()
