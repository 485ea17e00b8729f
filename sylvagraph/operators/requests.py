"""Intent and keywords of requests in natural language, English or Russian."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words whose presence marks a kind of request.
HINTS = {
    "bugfix": ["ломается", "сломалось", "не работает", "ошибка", "баг", "crash", "broken", "fails", "failing", "issue", "problem", "debug"],
    "feature": ["добавь", "добавить", "реализуй", "реализовать", "поддержку", "support", "implement", "feature"],
    "refactor": ["рефактор", "refactor", "упрости", "почисти", "перестрой", "restructure", "cleanup", "переведи", "замени", "обнови", "миграц", "migration", "switch", "upgrade", "replace"],
    "review": ["ревью", "review", "проверь", "audit", "аудит", "оцени"],
    "architecture": ["архитектур", "слой", "границ", "solid", "dependency", "design"],
    "security": ["security", "безопас", "xss", "csrf", "sql", "token", "cookie", "auth", "авторизац", "аутентификац"],
    "stabilization": ["нестабиль", "flaky", "memory leak", "утечк", "медленно", "slow", "performance", "hang", "зависает"],
    "campaign": ["все", "all", "массов", "миграц", "migration", "переведи", "замени", "replace", "switch", "upgrade", "across", "по всему", "повсюду", "несколько", "много", "сервисы", "service", "library", "библиотек"],
}
STOP_WORDS = ["и", "или", "но", "а", "не", "да", "как", "что", "это", "так", "для", "при", "про", "без", "если", "когда", "где", "почему", "надо", "нужно", "чтобы", "какой", "какая", "какие", "какого", "меня", "мой", "моя", "мои", "твой", "твоя", "его", "ее", "их", "наш", "ваш", "там", "тут", "очень", "просто", "после", "почему-то", "сломалось", "ломается", "ошибка", "проблема", "изменений", "проведи", "скажи", "найди", "причину", "риски", "before", "after", "with", "from", "that", "this", "user", "users", "the", "and", "for", "why", "how", "when", "where", "not", "into"]
#: Terms that a topic adds.
AUTH_TERMS = ["auth", "authentication", "login", "token", "cookie", "session"]
LOGIN_TERMS = ["login", "auth", "session"]
MOST_KEYWORDS = 8


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _ordered(text: Column) -> list[tuple[Column, str, str]]:
    """(test, kind, confidence) in the order in which they are asked."""
    has = {kind: _has(text, words) for kind, words in HINTS.items()}
    return [
        (has["bugfix"] & has["security"] & ~text.contains("ломает"), "security", "medium"),
        (has["bugfix"], "bugfix", "high"),
        (has["campaign"] & (has["refactor"] | has["feature"] | text.contains("нов") | text.contains("библиотек")), "refactor", "high"),
        (has["refactor"], "refactor", "high"),
        (has["feature"], "feature", "high"),
        (has["security"], "security", "medium"),
        (has["architecture"], "architecture", "medium"),
        (has["review"], "review", "medium"),
        (has["stabilization"], "stabilization", "medium"),
    ]


def intent(text: Column) -> tuple[Column, Column]:
    """The kind of a request and the confidence in it."""
    asked = F.lower(F.trim(text))
    kind, sure = F.lit("explore"), F.lit("low")
    for test, name, confidence in reversed(_ordered(asked)):
        kind, sure = F.when(test, name).otherwise(kind), F.when(test, confidence).otherwise(sure)
    return kind, sure


def keywords(text: Column, most: int = MOST_KEYWORDS) -> Column:
    """Quoted parts, file names and words of a request, in this order, without stop words and repeats; the first few."""
    asked = F.lower(text)
    words = lambda xs: F.array(*map(F.lit, xs))
    quoted = F.transform(F.regexp_extract_all(asked, F.lit(r"""["'`](.+?)["'`]"""), F.lit(1)), F.trim)
    files = F.regexp_extract_all(asked, F.lit(r"[\p{L}\p{N}_./-]+\.(?:ts|tsx|js|jsx|json|css|md)"), F.lit(0))
    tokens = F.filter(F.regexp_extract_all(asked, F.lit(r"[\p{L}\p{N}_-]{3,}"), F.lit(0)), lambda t: ~F.array_contains(words(STOP_WORDS), t))
    none = F.array().cast("array<string>")
    auth = F.when(asked.contains("авторизац") | asked.contains("auth"), words(AUTH_TERMS)).otherwise(none)
    login = F.when(asked.contains("логин"), words(LOGIN_TERMS)).otherwise(none)
    return F.slice(F.filter(F.array_distinct(F.concat(quoted, files, tokens, auth, login)), lambda t: t != ""), 1, most)


def inferred(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """``requests`` with task_kind, confidence and keywords."""
    kind, sure = intent(F.col(text_col))
    return requests.withColumn("task_kind", kind).withColumn("confidence", sure).withColumn("keywords", keywords(F.col(text_col)))
