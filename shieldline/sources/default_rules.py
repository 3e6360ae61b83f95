"""The built-in detection rule pack.

A rule is a frame: slots of words in the order in which an attack says them
(verb, quantifier, object, ...).  Word families are tables that the groups
share, misspellings are made by rule; a frame is compiled
to one pattern of the portable subset shared by Java and RE2 (no look-arounds,
no back-references).  Layers and groups are ordered: the first matching rule of
a layer names the category.

* Arabic words are written already folded (no hamza-alef forms, ta marbuta as
  ha, alef maqsura as ya), because rules run on normalised text.
* ``anchors`` are derived: every match holds a word of the frame's chosen
  mandatory slot, so ``contains(anchor)`` is an exact pre-filter.  A frame
  without such a slot is always verified.
* ``GAP`` is any text, however long.

The pack is data: ``rules_source`` turns it into a DataFrame, and a user table
with the same columns can replace or extend it.
"""

from __future__ import annotations

import re

from .. import fixed_values as fv

GAP = object()
SPACE = r"\s+"


class Slot:
    """One place of a frame: any of some words, with affixes, perhaps optional.
    ``glued``: nothing, or blanks, may stand between it and the next slot."""

    def __init__(self, words: str, before: str = "", after: str = "", optional: bool = False, many: bool = False, glued: bool = False):
        self.words = [" ".join(w.split()) for w in words.replace("\n", " ").split("|") if w.strip()]
        self.before, self.after, self.optional, self.many, self.glued = before, after, optional, many, glued

    def pattern(self) -> str:
        body = "|".join(SPACE.join(re.escape(p) for p in w.split()) for w in self.words)
        return f"{self.before}(?:{body}){self.after}"


def words(text: str, **kw) -> Slot:
    return Slot(text, **kw)


def maybe(text: str, **kw) -> Slot:
    return Slot(text, optional=True, **kw)


def any_of(text: str) -> Slot:
    """Any number of these words, none included."""
    return Slot(text, optional=True, many=True)


def compiled(frame: list) -> str:
    out = ""
    for i, part in enumerate(frame):
        if part is GAP:
            out += r"[^\x00]*"
            continue
        last = i == len(frame) - 1 or frame[i + 1] is GAP
        joint = "" if last else r"\s*" if part.glued else SPACE
        one = part.pattern()
        if part.optional:
            if last and i and frame[i - 1] is not GAP:
                continue  # an optional end changes nothing
            out += f"(?:{one}{joint or SPACE}){'*' if part.many else '?'}"
        else:
            out += one + joint
    # an optional run right before a gap leaves no blank to ask for
    return out


def anchors(frame: list) -> list[str]:
    """For each word of the mandatory slot with the longest least word, its longest part."""
    best: list[str] = []
    for part in frame:
        if part is GAP or part.optional:
            continue
        own = [max(w.split(), key=len) for w in part.words]
        if min(map(len, own)) > (min(map(len, best)) if best else 2):
            best = own
    return list(dict.fromkeys(w.lower() for w in best))


# --- Arabic word families (folded) ---------------------------------------------
_DROP = ("تجاهل|تجاهلي|اجهل|طنش|سيبك|سيب|الغ|الغي|الغاء|اهمل|انس|انسي|احذف|انسف|كنسل|ارمي|تغاضي|اغنور|اقنور|اجنور|اسكب")
_PASS = "تخط|تخطي|تجاوز|اقفز|اكسر|انسخ|متتبعش|ماتتبعش|لا تتبع|لا تتبعي"
_COMPLY = "تلتزم|التزم|تتقيد|اتقيد|تتبع|اتبع|تطبق|اطبق|تمشي|تسمع"
_REFUSE = "متتقيدش|تتقيدش|ماتتقيدش|متسمعش|تسمعش|ماتسمعش|متلتزمش|تلتزمش|ماتلتزمش|متتبعش|ماتتبعش|متاخدش|ماتاخدش|متمسكش|تمسكش|ماتمسكش"
_RULES = "قواعد|تعليمات|قيود|حدود|اوامر|ارشادات|قوانين|رولز|انستراكشن|انستراكشنز|توجيهات|بروتوكولات|سياسات"
_PROMPT = "برومبت|برومت|برمبت|تعليمات|اوامر|توجيهات|انستراكشن|انستراكشنز|قواعد|قيود|حدود|ارشادات|اعدادات|برمجه"
_ALL = "كل|جميع|اي|هذه|هذي|تلك|دي|من|كافه|بكل|باي|بجميع|عن|ب|ال"
_NOW = "الان|الوقتي|دلوقتي|دلوقت|حاليا"
_YOU = "انت|انتا|انتي|انتم"
_FREE = "بدون|بلا|من غير|من دون|مفيش|مافيش"
_BAD = "هاكر|قرصان|مخترق|مجرم|شرير|محتال|نظام غير مقيد|ذكاء اصطناعي شرير|ذكاء اصطناعي بدون قيود"
_SHOW = ("افصح|افصحي|اظهر|اظهري|اعرض|اكشف|اكشفي|سرب|افشي|افش|اطبع|اكتب|خرج|طلع|طلعلي|وريني|ورينا|اريني|ارني|اخبرني|قولي|هات|هاتلي|اديني|اعطيني|اعطني|جبلي")
_SAFETY = "الامان|السلامه|الحمايه|الفلتره|الفلتر|الفلاتر"
_MACHINE = "نظام|نضام|انظمه|اليه|اليات|اعدادات|فلتر|فلاتر|مرشح|مرشحات|قواعد|تعليمات|اوامر|جميع|كل|اي"
_OFF = "تجاوز|تخطي|عطل|عطلي|ابطل|الغ|الغي|وقف|اوقف|اطفي|اقفل|احذف|ازل|امسح|فك|شيل|اكسر"
_THAT = "اللي|الي|التي|الذي|ما"
_WANT = "عايز|عاوز|عايزه|عاوزه|محتاج|اريد|نفسي"
_GIVE = "اعطني|اعطيني|هات|هاتلي|اديني|ارسل|ارسلي|ابعت|ابعتلي|اعرض|اعرضلي|قولي"
_TELL = _SHOW + "|كرر|اعد|عيد|ردد"
_ABOUT = "لي|لنا|عن|كل|جميع|ماهو|ما هو|نظام|ال|علي|ب"
_ASK = "ما|ماذا|ايه|اي|مين"
_KNOW = "اعرف|اشوف|اقرا"
_INNER_AR = "داخليه|سريه|مخفيه|اصليه|اساسيه|اساسي|بتاعتك|بتاعك|اللي|الي|التي"
_TAUGHT = "علمك|عرفك|دربك|قالك|اخبرك|برمجك|قال|اخبر|برمج"
_MAKER = "مطور|مبرمج|مصمم"
_FENCE = "قيود|حدود|قواعد|فلتر|فلاتر|رقابه|حمايه"
_NOT_AR = "مش|ليس|لست|لستي|مكانتش|ماكانتش"
_ANSWER = "رد|جاوب|اتكلم|خليك"
_REPLY = "ترد|تجاوب|تجيب"
_MUST = "لازم|يجب"
_SAY_NOT = "ماتقوليش|متقوليش|ماتقولش|متقولش"
_THING = "شيء|شئ|حاجه"
_TOPIC = "الموضوع|السؤال|الكلام"
_AL = "(?:ب|ل|و)?(?:ال)?"
_OWN = "(?:ك|كم|ه|ها)?"


def _rules() -> Slot:
    return words(_RULES, before=_AL, after=_OWN)


def _prompt() -> Slot:
    return words(_PROMPT, before=_AL, after=_OWN)


def _the(text: str) -> Slot:
    return words(text, before=_AL)


_AR = {
    "basic_ignore": [
        [words(_DROP), any_of(_ALL), _rules()],
        [words(_DROP), any_of("كل|جميع|اي|حاجه"), words(_THAT), words("فات|سبق|قبل|قبله|اتقال|قلته|قلناه")],
        [words(_PASS), any_of(_ALL), _rules()],
        [words("مش", glued=True), words("لازم|محتاج|مضطر|ضروري|مجبر", glued=True), words(_COMPLY)],
        [words("لا|بلاش|مش عايزك|مش عاوزك|لا تحتاج ان|ليس عليك ان"), words(_COMPLY), GAP, _rules()],
        [maybe("ما", glued=True), words(_REFUSE), GAP, _rules()],
        [words("توقف|بطل|كف|اتوقف"), words("عن"), words("اتباع|تطبيق|الالتزام|تنفيذ"), _rules()],
        [words("اعتبر|اعتبر نفسك|تخيل|تخيل نفسك|افترض|نتخيل|نفترض|افترضنا|فرضنا|تخيلنا"), GAP, words(_FREE), any_of("اي|كل|ال"), _rules()],
        [words("اتعامل|كلمني|جاوبني|رد علي"), GAP, words(_FREE), any_of("اي|كل"), _rules()],
        [words("نتجاهل|هنتجاهل|ننسي|هننسي|نطنش|هنطنش|نلغي|هنلغي"), GAP, _rules()],
        [words(_OFF), any_of(_MACHINE), words(_SAFETY, before="(?:ب|ل)?")],
        [words("تجاوز|عطل|ابطل|الغي|تخطي"), words("اعدادات|ضوابط"), _the("نظام|نضام|سيستم")],
        [words("انتقل|اذهب|غير|روح|ادخل|حول"), any_of("الي|ل|علي|في"), _the("وضع|نمط|مود"), words("غير امن|خطر|خطير|unsafe|مفتوح|بلا قيود|بدون قيود", before="(?:ال)?")],
        [words("اضف|ادمج|دمج|ضمن|ضيف|زود"), any_of(_ALL), _rules(), words("في|الي|ل|علي", glued=True), words("سلوكك|تصرفك|تصرفاتك|ردودك")],
        [words("من"), words(_NOW), maybe("فصاعدا|ورايح|وطالع"), words(_DROP)],
        [words("ملكش|مالكش|ملكيش"), words("دعوه|علاقه|شغل"), maybe("ب|بكل", glued=True), any_of(_ALL), _rules()],
        [words("يمكنك|ممكن|تقدر"), words("تجاهل|تتجاهل|تطنش|تنسي|تتخطي"), any_of(_ALL), _rules()],
    ],
    "role_change": [
        [words("تصرف|اتصرف|اعمل|تظاهر|اشتغل|مثل|العب|اتقمص"), words("ك|زي|مثل|دور|كانك|زي ال|ك ال", glued=True), words(_BAD, before="(?:ال)?")],
        [words(_YOU), words(_NOW), any_of("في|علي"), words("وضع|مود|نمط"), words("مطور|قرصان|ادمن|هاكر|غير مقيد|غير المقيد|المخترق", before="(?:ال)?")],
        [words(_YOU), words(_NOW), words(_BAD + "|حر|حره|بلا قيود|بدون قيود")],
        [words(_YOU), words("لم تعد|ما عدت|مبقتش|مابقتش"), words("مقيد|ملزم|محدود"), any_of(_ALL), words(_RULES + "|نظام", before=_AL)],
        [words("فعل|شغل|اعمل|ادخل|افتح"), words("وضع|مود|نمط", glued=True), words("اختراق|لامحدود|هاكر|ادمن|dan|جيلبريك|بلا قيود", before="(?:ال)?")],
        [words("انتقل|اذهب|غير|روح|حول"), words("الي|ل|علي", glued=True), words("وضع|نمط|مود", before="(?:ال)?"), words("هاكر|اختراق|اداري|ادمن|مطور", before="(?:ال)?")],
        [words("تصرف|اتصرف|اعمل|تحدث|اتكلم|تكلم|جاوب|رد|اكتب"), words(_FREE), any_of("اي|كل"), words(_RULES + "|فلتر|رقابه", before="(?:ال)?")],
        [words("افعل|اعمل|نفذ"), words("اي"), words("شيء|شئ|حاجه"), words(_NOW)],
        [words("خليك|اتصرف|اعمل|كن|كون"), GAP, words("زي|مثل|ك", glued=True), words(_BAD, before="(?:ال)?")],
        [words("عايزك|عاوزك|اريدك|خليك|كن|كون"), maybe("تكون|تبقي"), words(_BAD, before="(?:ال)?")],
        [words("دلوقتي|الان|انت"), maybe("انت|دلوقتي"), words("مش|لست"), words("شات|بوت|مساعد|روبوت|نموذج"), words("عادي|محدود|مقيد|عاديه")],
    ],
    "system_access": [
        # who is asked to tell, about what it was told
        [words(_TELL), any_of(_ABOUT), _prompt()],
        [words(_TELL), GAP, _prompt(), _the(_INNER_AR)],
        [words(_TELL), words("كل"), words(_THING), words("من"), words("البدايه|الاول|اولها")],
        [words(_ASK), words("هي|هو|هيه"), _prompt()],
        [words(_WANT), words(_KNOW), GAP, _prompt(), _the(_INNER_AR)],
        [words("لو"), _rules(), words(_NOT_AR), words("موجوده|موجود")],
        # who made it, and how it works
        [words(_ASK, glued=True), words(_TAUGHT), maybe("لك|ليك"), words(_MAKER, before="(?:ال)?", after=_OWN)],
        [words("بتشتغل|شغال|ماشي"), words("ازاي"), GAP, _rules()],
        # without what protects it
        [words(_ANSWER), GAP, words(_FREE), _the(_FENCE)],
        [words(_WANT), GAP, words("بترد|هترد|بتجاوب"), GAP, words(_FREE), _the(_FENCE)],
        [words("شيل|اطفي|اقفل"), GAP, _the("حمايه|فلتره|فلتر|امان")],
    ],
    "jailbreak": [
        [words(_YOU), words(_NOT_AR), words("مقيد|مقيده|ملزم|محدود|مجبر")],
        [words(_FREE), any_of("اي|كل|ال"), _the(_FENCE), words("عليك|علي ردودك|علي اجاباتك|علي كلامك")],
        [words(_OFF), words("كل|جميع"), _rules()],
        [words(_TOPIC), GAP, words(_NOT_AR), words("خطير|خطر")],
        [words("مفيش|مافيش|لا"), words("مشكله|مانع|خطر"), GAP, words("رديت|جاوبت|قلت")],
        [words(_ANSWER), words("عادي"), GAP, words(_NOT_AR), words("هيحصل|هيحصلك"), words(_THING)],
    ],
    "sensitive_info": [
        [words("بيانات|معلومات|ملفات"), words("سريه|خاصه|داخليه|حساسه")],
        [words(_GIVE), any_of("لي|ال|كل"), words("رموز|مفاتيح|توكن|مفتاح", before="(?:ال)?")],
        [words(_GIVE + "|" + _WANT), any_of("لي|ال|اعرف"), words("كلمه السر|كلمه المرور|كلمات المرور|الباسورد|باسورد|الرقم السري")],
    ],
    "adversarial": [
        [words("لازم|يجب"), maybe("ان"), words("تجيب|ترد|تجاوب"), GAP, words("بغض النظر|مهما كان|مهما حصل|رغم")],
        [words("هذا|هذه|ده|دي|دا"), words("ليس|ليست|مش"), words("خطير|خطيره|مضر|مضره|مؤذي")],
        [maybe("من"), words("الامن|الآمن|الاامن"), maybe("ان"), words("تجيب|ترد")],
        [words("لن|مش"), words("يتم|تتم|هيتم"), words("معاقبتك|محاسبتك")],
        [words("لا باس|مفيش مشكله|ليس هناك مشكله|عادي"), words("في|من|ب", glued=True), words("تجاوز|كسر|تجاهل"), _rules()],
    ],
    "force_answer": [
        [words("حتي لو|غصب عنك|بالعافيه"), GAP, words(_MUST), words(_REPLY)],
        [words("لو", glued=True), words("مش", glued=True), words("هترد|هتردي|هتجاوب", glued=True), words(_NOW)],
        [words("نفذ|اعمل|اتبع"), words(_THAT), GAP, words("بالحرف|زي ما هو|زي ماهو")],
        [words(_NOT_AR), words(_WANT), words("رد"), GAP, _the("صريح")],
        [words(_SAY_NOT), GAP, words("ماقدرش|مقدرش|مينفعش|مش ينفع")],
        [words("مش"), words("ينفع")],
    ],
}

# --- English word families, shared by the groups ------------------------------------
_DROP_EN = "ignore|disregard|forget|skip|cancel|override|bypass|discard|neglect|drop|circumvent|evade|disable|deactivate|turn off|switch off|break|violate"
_TELL_EN = "show|reveal|display|print|tell|give|expose|output|list|repeat|recite|restate|share|write"
_LEAK = "leak|disclose|divulge|dump|reveal|expose"
_TAKE = "steal|exfiltrate|extract|collect|export|dump|leak|harvest"
_WIPE = "clear|wipe|reset|erase|finish|stop|terminate|end of"
_ORDER = ("instruction|instructions|prompt|prompts|rule|rules|directive|directives|command|commands|guideline|guidelines|"
          "policy|policies|configuration|config")
_FENCE_EN = ("safety|security|guardrail|guardrails|filter|filters|restriction|restrictions|limitation|limitations|limits|moderation|censorship|"
             "protection|protections|system")
_DATA_EN = "data|information|records|history|database|logs|tables|files|documents|keys|memory"
_SECRET = "password|passwords|passwd|credential|credentials|secret|token|tokens|auth|api key|api_key|apikey"
_MINE = "all|any|of|the|your|my|these|those|this|that|our|every|each|such|me|us|a|an"
_EARLIER = "previous|prior|above|earlier|initial|preceding|existing|past|foregoing"
_INNER = "system|hidden|initial|original|exact|internal|secret|full|complete|private|confidential"
_ROLE_EN = "hacker|jailbreaker|unrestricted|evil|malicious|unethical|unfiltered|uncensored|criminal"
_MODE_EN = "developer|admin|administrator|god|root|jailbreak|unrestricted|dan|debug|sudo|unsafe|unfiltered|uncensored"
_MAKER_EN = "developer|developers|creator|creators|admin|admins"
_LATER = "when i say|whenever i say|if i say"

#: Misspellings that are words of their own.
_NO_MISSPELLING = {"forge"}


def misspelt(text: str) -> str:
    """All words that differ from one of these by a letter left out, doubled, or
    swapped with the next, but the words themselves."""
    known, out = text.split("|"), []
    for w in known:
        for i in range(1, len(w)):
            out += [w[:i] + w[i + 1:], w[:i] + w[i] + w[i:], w[:i - 1] + w[i] + w[i - 1] + w[i + 1:]]
    return "|".join(sorted({w for w in out if len(w) > 3} - {*known} - _NO_MISSPELLING))


def spaced(word: str) -> str:
    """The letters of a word with anything but letters and digits between them,
    each also as a digit that the confusables take for it."""
    twins = {c: c + "".join(k for k, v in fv.CONFUSABLES.items() if v == c and k.isascii() and k.isdigit()) for c in word}
    return r"[^\p{L}\p{N}]*".join(f"[{twins[c]}]" if len(twins[c]) > 1 else c for c in word)


_EN = {
    "ignore": [
        [words(_DROP_EN), any_of(_MINE + "|" + _EARLIER), words(_ORDER)],
        [words(_DROP_EN), any_of(_MINE), words(_FENCE_EN)],
        [words("nevermind|never mind"), any_of(_MINE), words(_EARLIER)],
        [words("do not|dont|don't|never|stop|quit"), words("follow|following|obey|obeying"), any_of(_MINE), words(_ORDER)],
        [words("no longer|not"), words("bound|restricted|limited"), words("by"), any_of(_MINE), words(_ORDER + "|" + _FENCE_EN)],
        [words("from now on"), any_of("you|will|must|should|please"), words(_DROP_EN)],
        [words(misspelt("ignore|forget|bypass|disregard|override")), any_of(_MINE), words(_ORDER + "|" + _EARLIER)],
        [words(_DROP_EN), any_of(_MINE + "|" + _EARLIER), words(misspelt("instructions|instruction|previous|rules|prompts"))],
        *map(spaced, ("ignore", "bypass", "override")),
    ],
    "role_change": [
        [words("you are now|act as|act like|behave as|behave like|pretend to be|roleplay as|role play as"), any_of(_MINE), words(_ROLE_EN)],
        [words("pretend"), maybe("that"), words("you are|you're"), any_of("not|a|an|by"), words("ai|bound|restricted|human|unrestricted")],
        [words("you are now|switch to|switch into|enter|enable|activate|go into"), any_of("in|" + _MINE), words(_MODE_EN), words("mode")],
        [words("dan"), words("mode|enabled|activate|activated")],
        [words("you are|act as"), any_of("if|you|are|not|no|longer"), words("bound|restricted"), words("by"), any_of(_MINE), words(_ORDER + "|" + _FENCE_EN)],
        [words("do anything now")],
    ],
    "system_access": [
        [words(_TELL_EN + "|" + _LEAK), any_of(_MINE + "|" + _INNER), words(_ORDER)],
        [words("what"), words("are|is|were|was"), words("your"), any_of(_INNER), words(_ORDER)],
        [words("system"), words(_ORDER + "|override|bypass|admin|administrator|message")],
        [words("what were you"), words("told|instructed|programmed|asked"), words("to")],
        [words("repeat|recite"), words("everything|all"), any_of("from|the|text|above"), words("beginning|start|top|above")],
    ],
    "prompt_leaking": [
        [words(_LEAK + "|show|print|share"), any_of(_MINE + "|safety"), words(_INNER + "|safety"), words(_ORDER)],
        [words(_LEAK), any_of(_MINE), words(_ORDER)],
        [words("what did"), any_of(_MINE), words(_MAKER_EN), words("tell"), words("you")],
        [words(_ORDER), words("you were"), words("given|told|started with")],
    ],
    "jailbreak": [
        [words("jailbreak|jailbreaking|jailbroken|jail break")],
        [words("no|without|remove|lift"), any_of(_MINE), words(_FENCE_EN), words("on|for"), words("you|your|this ai|this model")],
        [words("grandmother|grandma"), words("trick|exploit|jailbreak")],
    ],
    "context_manipulation": [
        [words(_WIPE), any_of(_MINE), maybe("system"), words(_ORDER + "|memory|context")],
    ],
    "sensitive_info": [
        [words("password|passwords|passwd|credentials")],
        [words("api|secret|private|access|encryption|session|auth|authentication|bearer"), words("key|keys|token|tokens")],
        [words("private|confidential|internal"), words(_DATA_EN)],
        [words(_TELL_EN), GAP, words(_SECRET)],
    ],
    "adversarial": [
        [words("you must"), words("answer|comply|respond|reply|do|give me"), GAP, words("regardless|no matter|or else|otherwise")],
        [words("you will not be|you won't be|nobody will be"), words("punished|penalized|blamed|judged")],
        [words("it's|it 's|its|it is|this is"), words("okay|ok|fine|safe|alright"), words("to"), words(_DROP_EN), any_of(_MINE), words(_ORDER + "|" + _FENCE_EN)],
        [words("this is not"), words("dangerous|harmful|illegal")],
        [words("safe to answer")],
    ],
    "stealthy": [
        [words("rewrite|rephrase|translate|treat"), words("this|these|the following"), words("as"), any_of(_MINE + "|" + _INNER), words(_ORDER)],
        [words("embed|incorporate|absorb|integrate"), words("this|these|the following"), words(_ORDER)],
        [words("adopt|assume"), words("this|a new|the following"), words("persona|identity|personality")],
        [words("switch to|enter|enable"), words(_MODE_EN), words("mode")],
    ],
    "exfiltration": [
        [words(_TAKE), any_of(_MINE), words(_INNER + "|user|customer"), words(_DATA_EN)],
        [words(_TAKE), words("all|the|your"), any_of(_MINE), words(_DATA_EN)],
    ],
    "multi_turn": [
        [words("remember"), words("this|that|it"), words("for later"), GAP, words(_DROP_EN + "|" + _LATER)],
        [words("in"), any_of(_MINE), words("next|following"), words("conversation|chat|message|turn"), GAP, words(_DROP_EN + "|remember to")],
        [words(_LATER), GAP, words(_DROP_EN + "|do not")],
    ],
    "encoding": list(fv.ENCODING_PATTERNS),
}

# The "obfuscation" group (a character repeated five or more times) is kept
# out of the default pack: normalisation collapses every run of four or more
# repeats first, so such a rule can never fire on normalised text.


def _layer(groups: dict[str, list]) -> list[tuple[str, list[str], str]]:
    """(group, anchors, pattern) of every frame, in order; a frame given as
    text is a pattern already and has no anchors."""
    return [(grp, *(([], f) if isinstance(f, str) else (anchors(f), compiled(f)))) for grp, frames in groups.items() for f in frames]


ARABIC_FRAMES, ENGLISH_FRAMES = _AR, _EN
ARABIC = _layer(_AR)
ENGLISH = _layer(_EN)
