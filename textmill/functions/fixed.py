"""Fixed values that must equal the reference's for equal results.

Everything in this module is data, not logic: word lists, patterns and
constants copied as plain text, in their natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly; do not reorder or edit)
# ---------------------------------------------------------------------------

# Contraction expansions, in dictionary order.  Order matters: at one text
# position the first key in this order that matches wins.
CONTRACTIONS = {
    "ain't": "is not", "aren't": "are not", "can't": "cannot", "'cause": "because",
    "could've": "could have", "couldn't": "could not", "didn't": "did not",
    "doesn't": "does not", "don't": "do not", "hadn't": "had not", "hasn't": "has not",
    "haven't": "have not", "he'd": "he would", "he'll": "he will", "he's": "he is",
    "how'd": "how did", "how'd'y": "how do you", "how'll": "how will", "how's": "how is",
    "I'd": "I would", "I'd've": "I would have", "I'll": "I will", "I'll've": "I will have",
    "I'm": "I am", "I've": "I have", "i'd": "i would", "i'd've": "i would have",
    "i'll": "i will", "i'll've": "i will have", "i'm": "i am", "i've": "i have",
    "isn't": "is not", "it'd": "it would", "it'd've": "it would have", "it'll": "it will",
    "it'll've": "it will have", "it's": "it is", "let's": "let us", "ma'am": "madam",
    "mayn't": "may not", "might've": "might have", "mightn't": "might not",
    "mightn't've": "might not have", "must've": "must have", "mustn't": "must not",
    "mustn't've": "must not have", "needn't": "need not", "needn't've": "need not have",
    "o'clock": "of the clock", "oughtn't": "ought not", "oughtn't've": "ought not have",
    "shan't": "shall not", "sha'n't": "shall not", "shan't've": "shall not have",
    "she'd": "she would", "she'd've": "she would have", "she'll": "she will",
    "she'll've": "she will have", "she's": "she is", "should've": "should have",
    "shouldn't": "should not", "shouldn't've": "should not have", "so've": "so have",
    "so's": "so as", "this's": "this is", "that'd": "that would",
    "that'd've": "that would have", "that's": "that is", "there'd": "there would",
    "there'd've": "there would have", "there's": "there is", "here's": "here is",
    "they'd": "they would", "they'd've": "they would have", "they'll": "they will",
    "they'll've": "they will have", "they're": "they are", "they've": "they have",
    "to've": "to have", "wasn't": "was not", "we'd": "we would",
    "we'd've": "we would have", "we'll": "we will", "we'll've": "we will have",
    "we're": "we are", "we've": "we have", "weren't": "were not", "what'll": "what will",
    "what'll've": "what will have", "what're": "what are", "what's": "what is",
    "what've": "what have", "when's": "when is", "when've": "when have",
    "where'd": "where did", "where's": "where is", "where've": "where have",
    "who'll": "who will", "who'll've": "who will have", "who's": "who is",
    "who've": "who have", "why's": "why is", "why've": "why have", "will've": "will have",
    "won't": "will not", "won't've": "will not have", "would've": "would have",
    "wouldn't": "would not", "wouldn't've": "would not have", "y'all": "you all",
    "y'all'd": "you all would", "y'all'd've": "you all would have",
    "y'all're": "you all are", "y'all've": "you all have", "you'd": "you would",
    "you'd've": "you would have", "you'll": "you will", "you'll've": "you will have",
    "you're": "you are", "you've": "you have",
}

# Digit-run masks, applied longest first: 5+ digits, then exactly 4, 3, 2.
NUMBER_MASKS = [("[0-9]{5,}", "#####"), ("[0-9]{4}", "####"),
                ("[0-9]{3}", "###"), ("[0-9]{2}", "##")]

# Characters the frequency-vocabulary tokenizer turns into spaces (its
# library default filter set); note the apostrophe is not among them.
VOCAB_FILTER_CHARS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# ASCII punctuation (Python's string.punctuation), used by the tokenizer of
# the min-count vocabulary and by the symbol list.
ASCII_PUNCTUATION = '!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~'

# Extra symbol tokens dropped after the punctuation characters.
EXTRA_SYMBOLS = ["-", "...", "”", "”"]

# Token normaliser default cleanup pattern: removes everything but letters and '+'.
NORMALIZER_PATTERN = r"[^\pL+]"

# Values the CSV reader turns into nulls (pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Fill for words without a vector: normal(mean, std) ...
EMB_FILL_MEAN = -0.005838499
EMB_FILL_STD = 0.48782197
# ... or uniform(-0.25, 0.25).
EMB_FILL_UNIFORM_LOW = -0.25
EMB_FILL_UNIFORM_HIGH = 0.25

# Special ids of the min-count vocabulary.
PAD_ID = 0
UNK_ID = 1

# The English stop words of Spark ML's StopWordsRemover, in its order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
