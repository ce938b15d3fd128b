"""Word lists, patterns and thresholds the results depend on.

Every list is applied to every transcript whatever its language.
"""

# fillers
FILLER_WORDS = {
    "en": ["um", "umm", "uh", "uhh", "uhm", "erm", "hmm", "mm", "mhm", "basically", "literally", "actually", "honestly"],
    "hi": ["अं", "उम्म", "हम्म", "मतलब", "यार"],
    "hinglish": ["matlab", "yaar", "yar", "basically", "actually", "literally"],
}
FILLER_PHRASES = {
    "en": ["you know", "i mean", "kind of", "sort of", "you know what i mean"],
    "hi": ["क्या कहते हैं", "क्या बोलते हैं", "है ना"],
    "hinglish": ["kya kehte hain", "kya bolte hain", "hai na", "kya bolu"],
}
FILLER_INITIAL = {
    "en": ["so", "okay", "ok", "well", "right", "alright"],
    "hi": ["तो", "अच्छा", "देखो", "चलो"],
    "hinglish": ["toh", "achha", "acha", "accha", "dekho", "chalo", "okay", "ok", "so"],
}

# questions
INTERROGATIVES = {
    "en": ["what", "why", "how", "when", "where", "who", "which", "whats", "what's", "how's", "why's", "have", "do", "does", "did", "can", "could", "would", "should", "is", "are", "will"],
    "hi": ["क्या", "क्यों", "कैसे", "कब", "कहाँ", "कहां", "कौन", "कितना", "कितने", "कितनी"],
    "hinglish": ["kya", "kyun", "kyu", "kyon", "kaise", "kab", "kahan", "kaun", "kitna", "kitne", "kitni"],
}
QUESTION_TAGS = {"en": ["right"], "hi": ["ना", "क्या"], "hinglish": ["na", "kya"]}

# Number words ("one" and its translations usually mean "a")
NUMBER_WORDS = {
    "en": ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "hundred", "thousand", "million", "billion", "percent", "twice", "double", "half"],
    "hi": ["दो", "तीन", "चार", "पांच", "पाँच", "छह", "सात", "आठ", "नौ", "दस", "सौ", "हज़ार", "हजार", "लाख", "करोड़", "प्रतिशत", "आधा", "दुगना"],
    "hinglish": ["teen", "char", "chaar", "paanch", "panch", "chhe", "saat", "aath", "nau", "das", "sau", "hazaar", "hazar", "lakh", "crore", "percent", "aadha", "double"],
}

# Stopwords for repeated phrases
STOPWORDS = {
    "en": ["the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "is", "are", "was", "were", "be", "been", "it", "its", "it's", "this", "that", "these", "those", "i", "you", "we", "they", "he", "she", "my", "your", "our", "so", "as", "by", "from", "not", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could", "just", "then", "there", "here", "if", "about", "into", "than", "also", "very", "me", "us", "them"],
    "hi": ["का", "की", "के", "को", "में", "से", "है", "हैं", "था", "थी", "थे", "और", "या", "पर", "भी", "तो", "ही", "यह", "वह", "ये", "वो", "हम", "आप", "मैं", "जो", "कि", "ना", "नहीं", "हो", "कर", "एक"],
    "hinglish": ["ka", "ki", "ke", "ko", "me", "mein", "se", "hai", "hain", "tha", "thi", "the", "aur", "ya", "par", "bhi", "to", "toh", "hi", "yeh", "ye", "woh", "wo", "hum", "aap", "main", "jo", "na", "nahi", "ho", "kar", "ek"],
}

# Promise cues in the opening of a video
PROMISE_CUES = {
    "en": ["by the end", "i'll show you", "i will show you", "you'll see", "you will see", "you'll learn", "you will learn", "in this video", "today we", "today i", "stay till", "stick around", "later in this video", "i'm going to show", "we're going to", "we will"],
    "hinglish": ["is video mein", "is video me", "aaj hum", "aaj main", "end tak", "end mein", "dikhaunga", "dikhaungi", "bataunga", "bataungi", "sikhenge", "dekhenge", "samjhenge"],
    "hi": ["इस वीडियो में", "आज हम", "आज मैं", "आखिर में", "अंत तक", "दिखाऊंगा", "दिखाऊंगी", "बताऊंगा", "बताऊंगी", "सीखेंगे", "देखेंगे", "समझेंगे"],
}

# characters
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥“”‘’…—–«»"
CLOSERS = "\"'”’)]}»"
QUESTION_CLOSERS = "\"'”’)"
TERMINALS = [".", "?", "!", "।", "॥", "。", "？", "！"]
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "e.g.", "i.e.", "etc.", "vs.", "no.", "st."]
WORDS_PER_SECOND = {"en": 2.5, "hi": 2.2, "hinglish": 2.4}
DEFAULT_WORDS_PER_SECOND = 2.5

# Script mark-up removed before timing
LINK = r"\[([^\]]*)\]\([^)]*\)"
LIST_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+"
HEADING = r"^\s*#{1,6}\s*"
EMPHASIS = r"\*\*|__|\*|`"


def flat(lists: dict[str, list[str]]) -> list[str]:
    """All languages' entries, lower-cased, first mention kept."""
    return list(dict.fromkeys(w.lower() for words in lists.values() for w in words))
