"""Problem 5: template residue, filler and error pages.

Two ways lead to a verdict. (1) Records of every length are mined for message templates with a prefix tree of fixed depth: after
navigation lines are set aside and numbers, codes, paths and quoted names are masked, a record falls into the leaf of
its token count and its first tokens. The different records of a leaf are split into templates by similarity; a template
keeps the tokens that all its records share and a wildcard elsewhere. Each record is judged by itself, and a template's
verdict goes to all its records besides: it adds messages and takes none away. A record or template longer than a message
is judged by the share of its sentences and lines that are messages. A sentence is a message by a known wording or by a
frame: it names a thing (page, script, session, scan) and that thing's state (not found, required, expired, unreadable)
in one of many languages. One pass of an automaton finds the words that these need; only sentences with such words are
looked at more closely. The tree is never held in one place: leaves are keys of a shuffle, and only leaves with several
different records are split. (2) Every record is searched for unfilled
slots; a slot that is quoted, or stands in a sentence about templates, is only mentioned.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillstack.llm.common import arrow_map, spread
from quillstack.session import materialise

#: Depth of the prefix tree below the token count; the tokens up to which a record is judged as one message, a longer one
#: by its sentences and lines; the tokens of a stretch where a line longer than that has no stop.
DEPTH, LONGEST, STRETCH = 4, 64, 16
#: Share of equal places from which a record of a leaf belongs to a template.
SIMILAR = 0.6
#: Different records of a leaf that are mined together, on average.
LEAF_RECORDS = 20_000

# Words that name a field or tell the reader to fill it in.
_FIELD = (
    r"(?:insert|enter|add|your|eintragen|einsetzen|einfügen|ergänzen|ausfüllen|angeben|here|hier|tbd|name|vorname|nachname|titel|title|datum|date|"
    r"deadline|frist|semester|semesterzahl|studiengang|fakultät|fachbereich|modul|modultitel|kurs|course|raum|room|ansprechperson|contact|betreuung|"
    r"dozent|dozentin|paragraf|paragraph|version|abschluss|email|e-mail|telefon|adresse|address|ort|unterschrift|signature|text|placeholder|platzhalter)"
)
#: A single line break; a blank line ends a slot.
_NL = r"\n(?![^\S\n]*\n)"
_WORD = r"\p{L}[\p{L}\-]*"
_WORDS = rf"{_WORD}(?:(?: |{_NL}){_WORD}){{0,4}}"
#: Words of any number that begin or end with what to do.
_DEMANDED = rf"(?:please )?(?:insert|enter|add)(?:(?: |{_NL}){_WORD})++|(?:{_WORD}(?: |{_NL}))+(?:eintragen|einsetzen|einfügen|ergänzen|ausfüllen|angeben)"
#: Ways to write an unfilled slot. What stands inside ends at the next mark, however long it is.
SLOTS = regex.compile(
    rf"\{{\{{(?:[^{{}}\n]|{_NL})++\}}\}}|\$\{{(?:[^{{}}\n]|{_NL})++\}}|<%(?:(?!<%|%>)(?:[^\n]|{_NL}))++%>|\[\[(?:[^\[\]\n]|{_NL})++\]\]|\{{%(?:(?!\{{%|%\}})(?:[^\n]|{_NL}))++%\}}|"
    r"@@[\w.\-]++@@|##\p{L}[\w.\-]*+##|%\(\w++\)[sdif]|%\p{Lu}[\p{Lu}\d_.]++%|(?<![{$\w\\])\{\p{L}[\w.]++\}(?!\})|__\p{Lu}[\p{Lu}_]{2,}__|\bX{2,4}\.X{2,4}\.(?:X{2,4}|\d{0,2}X{2,4})|"
    rf"\b(?:TT|DD)\.MM\.(?:JJ|YY){{1,2}}\b|<\p{{Lu}}[\p{{Lu}}\-]{{2,}}(?:(?: |{_NL})[\p{{Lu}}\-]+)*+>|"
    rf"(?i:\[(?=[^\[\]]*\b{_FIELD}\b){_WORDS}\]|«(?=[^«»]*\b{_FIELD}\b){_WORDS}»|\[(?:{_DEMANDED})\]|«(?:{_DEMANDED})»)"
)
#: Without one of these no pattern of SLOTS matches.
_SIGNS = ("{", "<", "[", "@@", "##", "%", "«", "__", "XX.", ".MM.")
#: A sentence about templates or code, in which a slot is only mentioned.
ABOUT_SLOTS = regex.compile(r"(?i)\b(?:vorlagen?|platzhaltern?|templates?|placeholders?|syntax|variablen?|variables?|felder wie|fields like|schreibweise|notation|beispielsweise|gabarit|plantilla)\b")
_OPENING, _CLOSING = "„“\"'‚‘«»”`「『(", "“”\"'‘’»«`」』)"

#: Messages in place of page text, by kind.
MESSAGES = {
    "script": r"java ?script|\bjs\b|skripte? |scripts?\b.{0,40}(?:blocked|allow|enable|activ|turn)|(?:activer|active|allow|enable|turn on).{0,20}scripts?|browser.{0,60}(?:nicht unterst|not support|veraltet|outdated|update)|cookies?\b.{0,40}(?:einschalten|aktiv|enable|accept|allow)|inline frames|loading(?:…|\.\.\.)",
    "login": r"sitzung ist abgelaufen|session (?:has )?expired|melden sie sich (?:erneut |bitte )?an|bitte anmelden|please (?:log|sign) ?in|log ?in required|anmeldung erforderlich|sign in to continue|session expirée|veuillez vous connecter|inicie sesión",
    "error": r"\b[45]\d\d\b.{0,60}(?:not found|nicht gefunden|error|fehler|gateway|forbidden|verweigert|unavailable|verfügbar|requests|gone|serverfehler|anmeldung|timeout|introuvable)|(?:error|fehler|erreur)\s*(?:code\s*)?<\*>|^(?:error|fehler|erreur) \d|<\*> (?:not found|seite nicht gefunden|too many requests|gateway timeout|bad gateway|gone|forbidden|zugriff verweigert|interner serverfehler|internal server error|service unavailable|unauthorized|anmeldung erforderlich|dienst vorübergehend)|something went wrong|etwas ist schief|page not found|seite nicht gefunden|seite, die sie suchen|hilft unsere suche|page you (?:are looking for|requested)|angeforderte (?:adresse|seite)|requested (?:url|page|address)|traceback \(most recent|exception\b|stack ?trace|keyerror|database error|datenbankfehler|could not (?:open|connect)|render error|access denied|zugriff verweigert|bad gateway|gateway timeout|too many requests|interner serverfehler|internal server error|try again later|später erneut",
    "maintenance": r"wartungsarbeiten$|wartungsarbeiten(?:\s+<par>|:)|\bmaintenance\b|wird gewartet|(?:portal|system|dienst|seite|service|site) (?:ist|is|are|wird) (?:offline|down\b|temporarily|vorübergehend|(?:bis|until|derzeit|currently|wegen)\b(?=.*\b(?:nicht|not|offline|down|closed|gesperrt|geschlossen|gewartet|wartung|wartungsarbeiten|maintenance|unterbrochen|eingeschränkt|überarbeitet|aktualisiert|umgebaut|unavailable|unreachable|suspended)\b))|revient à|mantenimiento|back (?:at|online)|nicht erreichbar",
    "failure": r"(?:could|can) ?not be (?:transcribed|extracted|read|processed)|no text could be|extraktion nach|extraction (?:failed|aborted)|extraktion fehlgeschlagen|(?:kann|konnte) ich .{0,60}(?:nicht|keine)|ich kann .{0,60}(?:nicht|keine)|i (?:can'?t|cannot|can not|am unable|'m unable)|unable to (?:process|read|extract|transcribe|assist|help)|as an? (?:ai|assistant|language model)|not something i can|es tut mir leid|i'?m sorry|^sorry\b|keinen lesbaren text|nicht weiterhelfen|je ne peux pas|no puedo",
    "filler": r"lorem ipsum|dolor sit amet|\bmuster(?:text|überschrift|titel|absatz)|dummy|please overwrite|bitte überschreiben|noch (?:auszufüllen|zu ergänzen|einzufügen)|to be filled|fill in\b|blindtext|beispieltext|platzhaltertext|placeholder text|sample (?:text|heading|title)|dummy text|(?:hier|here) eintippen|tap here|click (?:here )?to (?:add|edit)|klicken sie,? um|hier steht (?:später|bald)|text folgt|wird (?:noch )?(?:ersetzt|ergänzt|nachgereicht)|asdf|qwert|überschrift ebene|neuer abschnitt|text text text|ebene zwei|\bn\.n\.|\bn\. n\.|\btbd\b|\btodo\b|\bxxx\b|coming soon|under construction|to be (?:added|completed|written|done)",
}
#: Frames of messages in many languages: (kind, things, states). Words match from a word's beginning, in
#: scripts without blanks anywhere; "$" asks for the word's end too.
FRAMES = (
    ("script", "javascript|java script|js$|scripts|scripting|skripte|script$|cookies|cookie$|browser|navigateur|navegador|przeglądar|tarayıc|trình duyệt|браузер|скрипт|πρόγραμμα περιήγησης|متصفح|ब्राउज़र|브라우저|스크립트|เบราว์เซอร์|浏览器|脚本|ブラウザ|スクリプト",
     "aktivier|deaktivier|einschalt|einzuschalten|eingeschaltet|ausgeschaltet|abgeschaltet|benötig|erforder|vorausgesetzt|zulassen|unterstütz|veraltet|blockier|enable|disable|require|needs|switched off|turned off|turn on|supported|outdated|blocked|activé|activez|active$|désactivé|nécessaire|requis|"
     "habilit|activa|desactiva|necesari|necesita|obsolet|abilita|richied|attiva|disattiva|vereist|nodig|inschakel|ingeschakeld|uitgeschakeld|verouderd|włącz|wyłącz|wymag|obsługiw|etkinleştir|gerekli|devre dışı|desteklen|bật|tắt|yêu cầu|включ|отключ|необходим|требу|поддерж|ενεργοποι|απαιτ|تفعيل|सक्षम|활성화|필요|เปิดใช้|启用|禁用|不支持|需要|有効|無効|必要|対応していません"),
    ("error", "seite$|webseite$|page$|pagina$|página$|strona$|strony$|sayfa$|trang$|страниц|σελίδα|صفحة|पृष्ठ|페이지|หน้า|页面|网页|ページ|server$|serveur$|servidor$|serwer|sunucu|máy chủ|сервер|διακομιστ|الخادم|सर्वर|서버|เซิร์ฟเวอร์|服务器|サーバ|adresse$|address$|url$|link$|lien$|enlace$|ressource$|resource$|anfrage$|request$|requête$|solicitud$|datei$|file$",
     "nicht gefunden|nicht vorhanden|existiert nicht|gibt es nicht|not found|does not exist|doesn't exist|cannot be found|could not be found|couldn't find|introuvable|n'existe|no encontrad|no se encontr|no se ha encontrado|no existe|non trovat|non esiste|non è stata trovata|niet gevonden|bestaat niet|niet worden gevonden|nie znaleziono|nie istnieje|nie została znaleziona|"
     "bulunamad|bulunmuyor|không tìm thấy|không tồn tại|не найден|не существует|δεν βρέθηκε|غير موجود|नहीं मिला|찾을 수 없|ไม่พบ|找不到|未找到|不存在|見つかりません|antwortet nicht|antwortet momentan nicht|antwortet derzeit nicht|antwortet zurzeit nicht|antwortet gerade nicht|überlastet|abgestürzt|nicht verfügbar|nicht beantwortet|nicht verarbeitet|fehlgeschlagen|"
     "not responding|does not respond|did not respond|overloaded|unavailable|failed$|timed out|ne répond pas|indisponible|surchargé|a échoué|no responde|no disponible|non risponde|non disponibile|reageert niet|niet beschikbaar|niet bereikbaar|nie odpowiada|niedostępn|yanıt vermiyor|kullanılamıyor|không phản hồi|не отвечает|недоступ|δεν ανταποκρίνεται|لا يستجيب|응답하지 않|无响应|不可用|応答し|利用できません"),
    ("maintenance", "portal|system$|dienst$|service$|website|webseite$|site$|plattform|platform|seite$|page$|server$|anwendung$|application$|servicio$|sitio$|sito$|servizio$|serwis|sayfa$|sistem$|hệ thống|сайт|портал|сервис|система$|ιστότοπος|الموقع|वेबसाइट|사이트|시스템|เว็บไซต์|ระบบ|网站|系统|サイト|システム",
     "gewartet|wartung$|wartungsarbeiten|maintenance|mantenimiento|manutenzione|onderhoud|konserwac|przerwa techniczna|bakım|bảo trì|обслуживани|технически|συντήρηση|صيانة|रखरखाव|점검|ปิดปรับปรุง|บำรุงรักษา|维护|メンテナンス|wieder verfügbar|kurzzeitig nicht|zeitweise nicht|be back shortly|be right back"),
    ("login", "sitzung$|session$|sesión|sessione|sessie$|sesja|oturum|phiên|сесси|сеанс|συνεδρία|الجلسة|सत्र|세션|เซสชัน|会话|セッション|zugang$|access$",
     "abgelaufen|beendet$|expired|timed out|expiré|caducad|expirad|scadut|verlopen|wygas|süresi doldu|sona erdi|hết hạn|истек|завершен|έληξε|انتهت|समाप्त|만료|หมดอายุ|过期|已超时|期限切れ|切れました"),
    ("login", "einloggen|einzuloggen|log in$|login$|sign in$|logged in|connectez-vous|vous connecter|connexion$|inicie sesión|iniciar sesión|accedi$|accedere$|inloggen|zaloguj|giriş yap|đăng nhập|войдите|авториз|συνδεθείτε|تسجيل الدخول|लॉग इन|로그인|เข้าสู่ระบบ|登录|ログイン",
     "bitte|please|must|need to|required|continue|again|erneut|erforderlich|weiter|veuillez|devez|requis|por favor|debe|continuar|nuevamente|per favore|devi|continuare|gelieve|moet|opnieuw|verder|proszę|się|ponownie|aby|lütfen|tekrar|devam|vui lòng|để|lại|пожалуйста|чтобы|снова|παρακαλώ|يرجى|कृपया|해 주세요|필요|โปรด|กรุณา|请|重新|してください"),
    ("failure", "text$|bild$|bildes|bilds|scan$|scans$|seite$|seiteninhalt|page$|pages$|ocr|dokument$|inhalt$|extraktion|texterkennung|transkription|verarbeitung|umwandlung|image$|picture$|content$|document$|extraction|transcription|recognition|conversion|texte$|contenu|imagen|texto|contenido|immagine|testo|contenuto|afbeelding|tekst|inhoud|obraz|treś|görüntü|metin|hình ảnh|văn bản|nội dung|изображен|текст|содержим|распознаван|εικόνα|κείμενο|الصورة|النص|छवि|पाठ|이미지|텍스트|ภาพ|ข้อความ|图像|图片|文字|内容|画像|テキスト",
     "nicht lesbar|unlesbar|unleserlich|kein text erkannt|nicht erkannt|nicht erkennen|nicht lesen|nicht gelesen|nicht entziffer|nicht ausgelesen|nicht extrahiert|nicht transkribier|nicht verarbeitet werden|nicht ausgewertet|nicht entnehmen|gescheitert|fehlgeschlagen|abgebrochen|misslungen|ohne ergebnis|"
     "illegible|unreadable|could not be read|cannot be read|could not be recognized|could not be recognised|not be transcribed|not be extracted|couldn't read|could not read|cannot read|unable to read|no text detected|no text was found|no readable|has failed|failed$|was aborted|illisible|n'a pas pu être|impossible de lire|impossible d'extraire|ilegible|no se pudo|no se ha podido|no es posible leer|"
     "illeggibile|non è stato possibile|impossibile leggere|onleesbaar|niet worden gelezen|kon niet worden|nieczyteln|nie udało się|okunamad|okunamıyor|çıkarılamad|không thể đọc|không đọc được|không trích xuất|не удалось|нечитаем|невозможно прочитать|δεν ήταν δυνατή|تعذر|لا يمكن قراءة|पढ़ा नहीं जा|읽을 수 없|추출하지 못|ไม่สามารถอ่าน|无法识别|无法读取|无法提取|読み取れません|抽出できません"),
)
#: Words of a sentence in a frame at most: a message is short, and a longer sentence talks about more than that.
FRAME_WORDS = 30


def _needed(pattern: str, most: int = 300) -> set[str]:
    """Literal strings, lower case, of which every match of a pattern holds at least one; taken from its parse.

    Neighbouring literals, alternatives and optional parts are multiplied out as long as there are no more than `most`."""
    from re import _constants as c, _parser

    def spelt(op, arg) -> set[str] | None:
        """All strings that an element can match, or None if they are not few."""
        if op is c.LITERAL:
            return {chr(arg)}
        if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            return {""}
        if op is c.IN and len(arg) <= 3 and all(o is c.LITERAL for o, _ in arg):
            return {chr(x) for _, x in arg}
        if op is c.SUBPATTERN:
            return whole(arg[3])
        if op is c.BRANCH:
            inner = [whole(x) for x in arg[1]]
            return None if None in inner else set().union(*inner)
        if op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[1] == 1:
            inner = whole(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def whole(seq) -> set[str] | None:
        out = {""}
        for element in seq:
            more = spelt(*element)
            if more is None or len(out) * len(more) > most:
                return None
            out = {x + y for x in out for y in more}
        return out

    def best(seq) -> set[str]:
        options: list[set[str]] = []
        run = {""}
        for op, arg in seq:
            more = spelt(op, arg)
            if more is not None and len(run) * len(more) <= most:
                run = {x + y for x in run for y in more}
                continue
            options.append(run)
            run = more or {""}
            if more is None and op is c.SUBPATTERN:
                options.append(best(arg[3]))
            elif more is None and op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
                options.append(best(arg[2]))
            elif more is None and op is c.BRANCH:
                inner = [best(x) for x in arg[1]]
                options.append(set().union(*inner) if all(inner) else set())
        return max((o for o in [*options, run] if o and "" not in o), key=lambda o: min(map(len, o)), default=set())

    return best(_parser.parse(pattern))


@lru_cache(maxsize=1)
def _signs() -> ahocorasick.Automaton:
    """Automaton of all words that a message needs: (length, whole word, (frame, 0 thing or 1 state) or None for a cue)."""
    words: dict[str, list] = {}
    for v in (*MESSAGES.values(), _CALLS):
        for w in _needed(v):
            words.setdefault(w, []).append((len(w), False, None))
    for k, (_, things, states) in enumerate(FRAMES):
        for role, group in enumerate((things, states)):
            for w in group.split("|"):
                bare = w.removesuffix("$")
                words.setdefault(bare, []).append((len(bare), w != bare, (k, role)))
    automaton = ahocorasick.Automaton()
    for w, uses in words.items():
        automaton.add_word(w, tuple(uses))
    automaton.make_automaton()
    return automaton


def _found(low: str) -> tuple[bool, set[tuple[int, int]]]:
    """(a cue may be there, the things and states of frames that are there) of a text in lower case."""
    cue, roles = False, set()
    for end, uses in _signs().iter(low):
        for n, whole, role in uses:
            if role is None:
                cue = True
            elif role not in roles:
                begin = end - n + 1
                if (begin == 0 or not low[begin - 1].isalpha() or low[begin] > "\u0e00") and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                    roles.add(role)
    return cue, roles


def _framed(roles: set[tuple[int, int]]) -> str | None:
    return next((FRAMES[k][0] for k, role in sorted(roles) if not role and (k, 1) in roles), None)


_MESSAGES = {k: re.compile(v) for k, v in MESSAGES.items()}
_ANY_MESSAGE = re.compile("|".join(f"(?:{v})" for v in MESSAGES.values()))
#: A sentence that talks about messages, scripts or filler instead of being one.
ABOUT = regex.compile(
    r"anleitung|erläuter|die meldung|erscheint|behandelt|der begriff|bezeichnet|wendet sich|verlänger|vorlesung|handbuch|fehlercodes?|kennung|the term|the message|explains|describes|discuss|"
    r"is called|lecture|course on|zu besprechen|studierende|candidates|students"
)
#: Labels of navigation, neither message nor text.
_ASIDE = regex.compile(r"^(?:zur(?:ück)?(?: zur)? startseite|startseite|menü|menu|home|back|zurück|login|suche|impressum|kontakt|datenschutz|folie <\*>|slide <\*>)\W*$")
#: Words of rules and of teaching; a sentence with one of them is no framed message.
_TALK = regex.compile(r"\b(?:prüfung|modul|kurs|antrag|anträge|frist|semester|fakultät|dekanat|student|studium|lehrveranstaltung|bewerb|zeugnis|klausur|exam|course|module|application deadline|faculty|degree|lecture|thesis|candidate|hausarbeit|§|abs\.|wird empfohlen|lernen|learn|cours\b|étudiant|examen|estudiante|curso|studente|corso|studenci|öğrenci|sinh viên|студент|学生|学習)|(?:muss|müssen|must|shall|should|soll|sollen) .{0,60}(?:eingereicht|vorgelegt|submitted)")
_LATIN = re.compile(r"[a-z]+")
_VISIBLE = regex.compile(r"\p{L}|<\*>")
_RIGHTS = regex.compile(r"^(?:\(c\)|©)", regex.I)
_BLOCKS = regex.compile(r"\n\s*\n")
_DIGIT = regex.compile(r"\d")
_NAVIGATION = regex.compile(r"^[^.!?]{1,80}$")
#: Quoted names, codes with a digit, paths and numbers; every one begins with a character of one class, which is quick to scan for.
_MASK = re.compile(
    r"""["'/\da-f](?:(?<=")[^"\n]{1,60}"|(?<=')(?<!\w.)[^'\n]{1,60}'|(?<![\w].)(?<=[0-9a-f])(?:(?<=\d)|(?=[a-f]*\d))[0-9a-f]{5,}\b|(?<=/)(?<!\w/)[\w./\-]+|(?<=\d)\d*(?:[.:,]\d+)*)"""
)
_BREAK = regex.compile(r"(?:(?<=[.!?…])[\"”“»)\]]*\s+)|\s*<par>\s*")
_UNREAL = regex.compile(r"(?i)^x{2,}[.,;:!?]?$")
#: Cues that are single words of many subjects too. A long record of nothing but these is no message.
_BARE = re.compile(r"java ?script|\bjs\b|exception\b|\bmaintenance\b|dummy|\bn\.\s?n\.|\btbd\b|\btodo\b|\bxxx\b")
_DEMAND = re.compile(r"aktivier|einschalt|benötig|erforder|deaktiv|blockier|enabl|turn on|requir|disabled|blocked|activ")
#: Lines of a stack trace; the line behind a "File" line is code.
_CALLS = r"traceback \(most recent|\bfile \S+, line (?:\d+|<\*>)|\bat [\w.$<>*/]+ ?\((?:\S*:(?:\d+|<\*>)|native method|unknown source)"
_CALL = re.compile(_CALLS)
_FRAME = re.compile(_CALLS + r"|caused by:|\.\.\. (?:\d+|<\*>) (?:more|common frames)|during handling of the above|[\w.]*\w(?:error|exception)(?::|$)")
_CODE_LINE = re.compile(r"file \S+, line (?:\d+|<\*>), in ")
_ITEM = re.compile(r"(?:[-•*–·▪◦]|(?:<\*>|\w)[.)]) ")
#: Sentences that go with a message and say nothing themselves; they count neither way.
_COURTESY = re.compile(r"(?:ihr|um) verständnis|vielen dank|danke für|thank you|apologi[sz]e|inconvenience|entschuldigen|unannehmlichkeit|\bhelpdesk\b|wenden sie sich an|contact (?:us|the)|versuchen sie es|try again|freundliche grüße|kind regards")
#: Words of the usual filler text, and small Latin words, which count neither way.
_LATIN_SMALL = frozenset("ab ac ad at aut cum de diam dis do e et ex erat est eu hac id in mi ne nec nisi non nunc per quam qui quis sed sem si sit te ut vel".split())
_LOREM = frozenset(
    "lorem ipsum dolor amet consectetur consectetuer adipiscing adipisicing adipisci elit elitr eiusmod tempor incididunt labore dolore dolores doloremque magna aliqua aliquam enim minim minima veniam "
    "nostrud nostrum exercitation exercitationem ullamco ullam laboris nisi aliquip aliquid aliquet commodo commodi consequat consequatur consequuntur duis aute irure reprehenderit voluptate voluptas "
    "voluptatem velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum nonumy eirmod invidunt aliquyam sadipscing voluptua vero eos "
    "accusam accusamus accusantium justo iusto duo rebum stet clita kasd gubergren sea takimata sanctus vulputate molestie illum feugiat feugait facilisis eros accumsan odio dignissim blandit praesent luptatum "
    "zzril delenit augue nonummy nibh euismod tincidunt laoreet volutpat wisi tation ullamcorper suscipit lobortis nisl iriure hendrerit nam liber tempor soluta nobis eleifend option congue nihil imperdiet doming placerat facer possim assum "
    "perspiciatis unde omnis iste natus error totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo aspernatur odit fugit magni ratione sequi nesciunt "
    "maecenas phasellus vestibulum curabitur pellentesque donec fusce vivamus integer mauris morbi proin nullam cras etiam sagittis tellus lectus massa turpis egestas tortor purus faucibus ultrices ultricies "
    "posuere cubilia curae luctus fermentum condimentum bibendum scelerisque viverra mattis porttitor porta semper libero gravida risus arcu cursus metus varius sodales tristique senectus netus malesuada fames "
    "habitant venenatis pretium ornare dapibus rhoncus interdum convallis elementum sollicitudin lacus ligula quisque suspendisse potenti aenean maximus efficitur finibus auctor neque leo urna orci sapien "
    "dictum pulvinar mollis iaculis lacinia tempus vehicula pharetra fringilla eget felis quam ante primis nascetur ridiculus mus penatibus magnis parturient montes natoque sociis platea dictumst habitasse".split()
)

#: Frequent small words; running text of these languages has some of them in every few sentences.
SMALL_WORDS = frozenset(
    "der die das und in den dem des zu im von mit ist auf für nicht wird ein eine einer einem einen am an bei nach durch als auch oder um bis wer ob zur zum sind kann "
    "the of and to a is for by on are be as at or from this that it not with will may must each no both if "
    "le la les un une et du au aux est en pour sur dans par ne pas que se ce des sans el los las y del con por su sin al lo cada "
    "ve bir bu için ile ne da de olarak her yeni jest się na nie do i z w że ten bez każdy czy các và của là cho có không được với trong một mỗi khi nếu "
    "il di che è per una con non sono het een van op te dat".split()
)


def quoted(text: str, a: int, b: int) -> bool:
    return a > 0 and b < len(text) and text[a - 1] in _OPENING and text[b] in _CLOSING


def sentence_around(text: str, a: int, b: int) -> str:
    """Roughly the sentence: to the nearest stop or line's end on both sides."""
    left = max(text.rfind(s, max(0, a - 300), a) for s in (". ", "! ", "? ", "\n\n"))
    right = min((k for s in (". ", "! ", "? ", ".\n", "\n\n") if (k := text.find(s, b, b + 300)) >= 0), default=min(len(text), b + 300))
    return text[left + 1 : right + 1]


def has_slot(text: str) -> bool:
    """True if the text has a slot that nobody filled and that is not merely mentioned."""
    if not any(sign in text for sign in _SIGNS):
        return False
    for m in SLOTS.finditer(text):
        if not quoted(text, m.start(), m.end()) and not ABOUT_SLOTS.search(SLOTS.sub(" ", sentence_around(text, m.start(), m.end()))):
            return True
    return False


def is_filler_prose(text: str) -> bool:
    """Invented words in sentences: no small word of any language, hardly any capital inside, no figures or lists."""
    words = text.split()
    if len(words) < 4:
        return False
    if "xx" in text.lower() and sum(bool(_UNREAL.match(w)) for w in words) >= 0.8 * len(words):
        return True
    if len(words) < 8 or "|" in text or not text.replace("…", "").isascii() or _DIGIT.search(text):
        return False
    plain = [w.strip(".,;:!?…()\"'") for w in words]
    if any(not w.isalpha() or not w.isascii() for w in plain) or sum(w.lower() in SMALL_WORDS for w in plain) > 0:
        return False
    inner = [w for w, before in zip(plain[1:], words, strict=False) if before[-1] not in ".!?…"]
    return sum(w[0].isupper() for w in inner) <= 0.1 * max(1, len(inner)) and any(w[-1] in ".!?" for w in words)


def _lines(text: str) -> list[list[str]]:
    """The blocks of a record with their lines, white space made even and navigation lines set aside, unless these say
    what a message says."""
    blocks = []
    for block in _BLOCKS.split(text.strip()):
        lines = []
        for line in block.split("\n"):
            line = " ".join(line.split())
            if not line:
                continue
            apart = len(line) <= 80 and (" | " in line or " · " in line or " – " in line or " — " in line) and _NAVIGATION.match(line) and line[0] != "|" and not _kind(line.lower())
            if not apart and not (line[0] in "(©" and _RIGHTS.match(line)):
                lines.append(line)
        if lines:
            blocks.append(lines)
    return blocks


def message_tokens(text: str, blocks: list[list[str]] | None = None) -> list[str] | None:
    """Masked tokens of a record that can be one message; None for others. <par> stands for a blank line."""
    if len(text) > 40 * LONGEST or len(text.split()) > 4 * LONGEST:
        return None
    tokens = _MASK.sub("<*>", " <par> ".join(" ".join(lines) for lines in blocks or _lines(text))).split()
    return tokens if 0 < len(tokens) <= LONGEST else None


def long_tokens(text: str, blocks: list[list[str]] | None = None) -> list[str]:
    """Masked tokens of a record of any length, line by line. <nl> stands for a line's end, <par> for a blank line."""
    return _MASK.sub("<*>", " <par> ".join(" <nl> ".join(lines) for lines in blocks or _lines(text))).split()


def verdict(long: bool, template: str) -> str | None:
    """Verdict on a record or template: a short one as one message, a long one by its sentences and lines."""
    if not long:
        return classify(template)
    return judge_long(template.replace(" <par> ", "\n\n").replace(" <nl> ", "\n"))


def is_lorem(part: str, share: float = 0.6) -> bool:
    """True if such a share of the words of a lower-case text are those of the usual filler text."""
    words = [w for x in part.split() if (w := x.strip(".,;:!?…()\"'")) and w not in _LATIN_SMALL]
    return len(words) >= 2 and sum(w in _LOREM for w in words) >= share * len(words)


def _kind(part: str) -> str | None:
    """The kind of message that a lower-case sentence is; a sentence about messages is none."""
    cue, roles = _found(part)
    framed = _framed(roles)
    if (cue or framed) and ABOUT.search(part):
        return None
    known = next((kind for kind, pattern in _MESSAGES.items() if pattern.search(part)), None) if cue else None
    if known or framed and len(part.split()) <= FRAME_WORDS and not _TALK.search(part):
        return known or framed
    return "filler" if is_lorem(part) and not ABOUT.search(part) else None


def _may_be_message(low: str) -> bool:
    """False for a lower-case text that holds nothing a message needs."""
    cue, roles = _found(low)
    return cue or _framed(roles) is not None or len(_LOREM.intersection(_LATIN.findall(low))) >= 2


def classify(template: str) -> str | None:
    """Verdict on a template (masked tokens joined by blanks): the kind of message, or None for page text.

    At least half of its sentences must be messages; a sentence about messages is none."""
    low = template.lower()
    if not _may_be_message(" ".join(low.split())):
        return None
    parts = [p for p in _BREAK.split(low) if p and _VISIBLE.search(p)]
    parts = [p for p in parts if not _ASIDE.match(p)]
    found: dict[str, int] = {}
    for part in parts:
        if kind := _kind(part):
            found[kind] = found.get(kind, 0) + 1
    whole = sum(found.values())
    if whole and 2 * whole >= len(parts):
        return max(found, key=lambda k: found[k])
    return None


def _long_parts(lines: list[str]) -> list[tuple[str, bool]]:
    """(part, line of a stack trace) of a block in lower case: sentences over line breaks, but lines where there are more
    than LONGEST tokens without a stop, and stretches where even a line has more."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []

    def flush() -> None:
        for part in _BREAK.split(_MASK.sub("<*>", "\n".join(text))):
            if len(part.split()) <= LONGEST:
                out.append((" ".join(part.split()), False))
                continue
            for line in part.split("\n"):
                words = line.split()
                step = STRETCH if len(words) > LONGEST else LONGEST
                out.extend((" ".join(words[k : k + step]), False) for k in range(0, len(words), step))
        text.clear()

    code = False
    for line in lines:
        low = line.lower()
        if code or _FRAME.match(low):
            flush()
            out.append((low, True))
            code = not code and bool(_CODE_LINE.match(low))
        else:
            text.append(low)
    flush()
    return [(p, frame) for p, frame in out if _VISIBLE.search(p) and not _ASIDE.match(p)]


def judge_long(text: str) -> str | None:
    """Verdict on a record that is too long to be one message, from all of its text.

    Half of its words must lie in sentences or lines that are messages, and one of these must be more than a word that
    subjects of study share. The items of a list behind a message count with it, courtesies count neither way."""
    low = text.lower()
    if not _may_be_message(" ".join(low.split())):
        return None
    found: dict[str, int] = {}
    total, firm = 0, False
    listed = None
    for lines in _lines(text):
        for part, frame in _long_parts(lines):
            n = len(part.split())
            kind = "error" if frame or _CALL.search(part) else _kind(part)
            if kind is None and listed and _ITEM.match(part):
                kind = listed
            elif kind is None and _COURTESY.search(part) and not ABOUT.search(part):
                continue
            else:
                listed = kind if part.endswith(":") else None
                firm = firm or bool(kind) and (frame or not _BARE.search(part) or bool(_DEMAND.search(part)) or bool(_ANY_MESSAGE.search(_BARE.sub(" ", part))))
            total += n
            if kind:
                found[kind] = found.get(kind, 0) + n
    if firm and 2 * sum(found.values()) >= total:
        return max(found, key=lambda k: found[k])
    return None


def judge(df: DataFrame, id_col: str, text_col: str, balance: bool = True) -> DataFrame:
    """(id, slot boolean, kind string) of every record that is residue: slot for an unfilled slot, kind for a message
    or filler. Deliveries of an id count once. Null and blank texts are never residue.

    Leaves with several different records are found on two numbers a record; only their records are brought together."""
    parsed = materialise(_parse(df, id_col, text_col, balance), "parsed")
    placed = parsed.where("leaf IS NOT NULL")
    code = F.xxhash64("line")
    several = placed.groupBy("leaf").agg(F.min(code).alias("a"), F.max(code).alias("b"), F.max(F.col("kind").isNull()).alias("open")).where("a <> b AND open").select("leaf")
    shared = materialise(placed.join(materialise(several, "leaves"), "leaf", "left_semi").select("id", "leaf", "line", "kind"), "shared")
    merged = templates(shared).where("kind IS NOT NULL")
    verdicts = merged.select("leaf", F.explode("members").alias("line"), F.col("kind").alias("verdict"))
    by_message = shared.where("kind IS NULL").join(verdicts, ["leaf", "line"]).select("id", F.lit(False).alias("slot"), F.col("verdict").alias("kind"))
    alone = parsed.where("slot OR filler OR kind IS NOT NULL").select("id", "slot", F.least("kind", F.when(F.col("filler"), "filler")).alias("kind"))
    out = by_message.unionByName(alone).groupBy("id").agg(F.max("slot").alias("slot"), F.min("kind").alias("kind"))
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def _similar(lines: list[str]) -> list[tuple[str, list[int]]]:
    """(template, its members) of lines with equally many tokens. The first line that has no template yet leads one, and
    all others without one that share SIMILAR of its places belong to it."""
    codes: dict[str, int] = {}
    rows = np.array([[codes.setdefault(token, len(codes)) for token in line.split(" ")] for line in lines], dtype=np.int32)
    words, rest, out = list(codes), np.arange(len(lines)), []
    while rest.size:
        near = (rows[rest] == rows[rest[0]]).mean(axis=1) >= SIMILAR
        members, rest = rest[near], rest[~near]
        same = (rows[members] == rows[members[0]]).all(axis=0)
        out.append((" ".join(words[c] if kept else "<*>" for c, kept in zip(rows[members[0]], same, strict=True)), members.tolist()))
    return out


def templates(placed: DataFrame) -> DataFrame:
    """(leaf, template, records, kind, members): one row for each template, with the different masked records (tokens
    joined by blanks) that it covers; placed: (leaf, line). Only the different records of a leaf come together, in parts of
    about LEAF_RECORDS that are mined each by itself, so no task holds a leaf of any size."""
    once = placed.groupBy("leaf", "line").agg(F.count("*").alias("n"))
    sizes = once.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_RECORDS).alias("_parts"))
    dealt = once.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("line"), F.col("_parts")).alias("part"), "line", "n")

    def mined(leaf: int, lines: list[str], n: list[int]) -> list[tuple]:
        long = lines[0].count(" ") >= LONGEST or " <nl> " in lines[0]
        return [(leaf, t, sum(n[k] for k in own), verdict(long, t), [lines[k] for k in own]) for t, own in _similar(lines)]

    def run(batches):
        key, lines, n, out = None, [], [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _MINED, strict=True)], names=["leaf", "template", "records", "kind", "members"])

        for batch in batches:
            for leaf, part, line, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leaf, part) != key:
                    if lines:
                        out += mined(key[0], lines, n)
                    key, lines, n = (leaf, part), [], []
                lines.append(line)
                n.append(times)
            if len(out) >= 1000:
                yield rows()
                out = []
        if lines:
            out += mined(key[0], lines, n)
        if out:
            yield rows()

    ordered = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
    return ordered.mapInArrow(run, "leaf bigint, template string, records bigint, kind string, members array<string>")


_MINED = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))


def place(text: str) -> tuple[int | None, str | None, str | None]:
    """(leaf, line, kind) of a record: its leaf in the tree as a number, its masked tokens, and its own verdict. Nulls
    for a record without tokens."""
    blocks = _lines(text)
    words, long = message_tokens(text, blocks), False
    if words is None:
        words, long = long_tokens(text, blocks), True
    if not words:
        return None, None, None
    line = " ".join(words)
    return xxhash.xxh3_64_intdigest(f"{long} {len(words)} {' '.join(words[:DEPTH])}") - (1 << 63), line, verdict(long, line)


def _parse(df: DataFrame, id_col: str, text_col: str, balance: bool) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        leaves, lines, kinds = zip(*map(place, texts), strict=True) if texts else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([has_slot(t) for t in texts], pa.bool_()), pa.array([is_filler_prose(t) for t in texts], pa.bool_()), pa.array(leaves, pa.int64()), pa.array(lines, pa.string()), pa.array(kinds, pa.string())],
            names=["id", "slot", "filler", "leaf", "line", "kind"],
        )

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return arrow_map(spread(source) if balance else source, run, f"id {kind}, slot boolean, filler boolean, leaf bigint, line string, kind string")
