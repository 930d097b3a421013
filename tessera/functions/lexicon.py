"""Word lists by category."""

from __future__ import annotations

# The lexicon's categories and words.
CATEGORIES: dict[str, str] = {
    "first_person_singular": "i me my mine myself",
    "first_person_plural": "we us our ours ourselves",
    "second_person": "you your yours yourself yourselves",
    "third_person": "he him his himself she her hers herself they them their theirs themselves",
    "negation": "no not never none nothing nowhere neither nor cannot can't don't doesn't didn't won't wouldn't shouldn't couldn't isn't aren't wasn't weren't haven't hasn't hadn't",
    "absolutist": "always never completely totally absolutely everything nothing everyone nobody entirely forever",
    "body": "blood skin heart head eyes eye face hands hand bones body breath",
    "darkness": "dark darkness shadow shadows night black empty emptiness cold dead death die dying",
    "pain": "pain hurt hurting ache broken break breaking wound wounded scar scars suffer suffering",
    "hope": "hope light rise rising alive tomorrow believe healing heal free freedom",
    "conflict": "fight war battle enemy enemies rage anger angry hate attack",
    "isolation": "alone lonely isolate isolated inside away apart lost nobody silence",
    "time": "time again before after past future today tonight tomorrow yesterday forever",
}
EMOTIONS = "anger anticipation disgust fear joy sadness surprise trust positive negative".split()

# Small tables of our own, for use without a user's (emotion, token) and (token, valence) rows.
EMOTION_WORDS: dict[str, str] = {
    "anger": "rage hate fury angry mad furious", "anticipation": "await expect soon ready plan hope", "disgust": "trash scum filth vile rotten sick",
    "fear": "fear afraid dread panic terror scared", "joy": "joy happy laugh delight smile glad", "sadness": "lost alone grief cry mourn sorrow",
    "surprise": "sudden amazed wonder shock astonished startled", "trust": "trust faith honest loyal safe friend",
    "positive": "good love hope free kind bright joy", "negative": "bad hate pain idiot scum ugly stupid",
}
VALENCES: dict[str, float] = {
    "amazing": 2.8, "awful": -2.0, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "cry": -2.1, "fear": -2.2, "free": 2.3, "friend": 2.2, "glad": 2.0, "good": 1.9, "great": 3.1,
    "happy": 2.7, "hate": -2.7, "hope": 1.9, "horrible": -2.5, "idiot": -2.3, "joy": 2.8, "kind": 2.4, "light": 0.5, "love": 3.2, "moron": -2.2, "nice": 1.8, "pain": -2.3,
    "pathetic": -2.7, "sad": -2.1, "scum": -2.6, "smile": 1.5, "stupid": -2.4, "terrible": -2.1, "trash": -1.9, "ugly": -2.3, "vile": -3.1, "worst": -3.1, "worthless": -1.9, "like": 1.5,
}


def words(category: str) -> list[str]:
    return CATEGORIES[category].split()
