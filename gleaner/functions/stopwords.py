"""Fixed word lists.

FIXED VALUES - these must equal the lists the original pipeline used, so they
are written out literally, in their natural order.

``ENGLISH_STOPWORDS`` is the public NLTK English stopword corpus (179 words,
the long-standing release of ``stopwords.words("english")``).
``NEGATION_KEEP`` are the negation / opinion words that segmentation keeps as
content words.  ``TOPIC_FILLER`` are the filler words removed when counting
words of topic descriptions.
"""

from __future__ import annotations

# --- fixed values: NLTK English stopwords, in corpus order -----------------
ENGLISH_STOPWORDS: tuple[str, ...] = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
)

# --- fixed values: negation / opinion words kept by segmentation -----------
NEGATION_KEEP: tuple[str, ...] = (
    "no", "not", "nor", "never",
    "don't", "dont", "didn't", "didnt",
    "shouldn't", "shouldnt", "can't", "cant",
    "won't", "wont", "isn't", "isnt", "aren't", "arent",
    "wasn't", "wasnt", "weren't", "werent",
    "couldn't", "couldnt", "wouldn't", "wouldnt",
    "n't",
)

# --- fixed values: filler words dropped from topic-description counts ------
TOPIC_FILLER: tuple[str, ...] = ("the", "and", "of", "to", "in", "for", "a", "an", "is")


def segmentation_stopwords() -> list[str]:
    """English stopwords minus the negation keep-list (order preserved)."""
    keep = set(NEGATION_KEEP)
    return [w for w in ENGLISH_STOPWORDS if w not in keep]


def coherence_stopwords() -> list[str]:
    """The full English list; coherence tokenising keeps no negations."""
    return list(ENGLISH_STOPWORDS)
