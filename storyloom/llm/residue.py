"""Template residue and error-page text: character n-gram models with likelihood-ratio windows.

Models of what stands in the place of an article (filler, error notices and demands for scripts, unfilled placeholders, missing values)
start from short general seeds and learn more from contents of the corpus that they cover; one of natural text is fitted on all contents,
whose n-grams are counted in tasks. Each character n-gram then has a log likelihood ratio; windows in which it is high localise residue. Filler and notices count
when they cover most of a paragraph; placeholders count wherever they stand outside quotation marks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable
from .pages import paragraphs, parse

#: Covered share of a content from which the next round learns from all of it.
LEARN = 0.5
BITS = 18
#: Characters of texts that are gone through in one go (their arrays then fit a core's cache), and that a task holds before it counts them.
CHUNK, HELD = 200_000, 1_000_000
#: Places of a vector of counts that are one row.
SLICE = 1 << 14
WINDOW, VALUE_WINDOW = 14, 7
#: Mean ratio of a window of residue: while learning, and in the end.
SURE, MEAN = 1.2, 0.9
#: Sum of the ratios of two successive outlines that makes a placeholder: about that of two that natural text never shows.
OUTLINES = 13.5

# Seeds of filler text (the usual Latin dummy text and what layout programs and editors put where text is to follow).
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia.
Donec quam felis, ultricies nec, pellentesque eu, pretium quis, sem. Nulla consequat massa quis enim. Aenean leo ligula, porttitor eu, consequat vitae, eleifend ac, enim. Phasellus viverra nulla ut metus varius laoreet.
Quisque rutrum. Aenean imperdiet. Etiam ultricies nisi vel augue. Curabitur ullamcorper ultricies nisi. Nam eget dui. Maecenas tempus, tellus eget condimentum rhoncus, sem quam semper libero, sit amet adipiscing sem neque sed ipsum.
Mauris mollis orci a risus porta lacus. Sapien nunc eget odio. Integer tincidunt. Cras dapibus. Vivamus elementum semper nisi.
Insert your text here. Enter text here. Type something here. Click to add text. Add body copy here. Edit this text. Put your content here. Main text goes in this space.
Headline goes here. Subtitle goes here. Caption to come. Copy to follow. More text to come. Story to be written. Title to be confirmed, three lines. Lead paragraph to come, fifty words.
This is a placeholder. This text is a placeholder and will be replaced. Placeholder content for the page layout; remove it before going live. Sample text block. This is sample content. Replace this paragraph with your own words.
Dummy text for testing the layout. This is some dummy text. This paragraph is only a test. Test post, do not publish. Just a test article. Testing one two three.
XXXX XXXXX XXXXXX XXXXXXX XXXXXXXX XXX XXXXXXXXX xxx xxxx xxxxx xxxxxx xx xxxxxxx.
test test test test. bla bla bla. blah blah blah blah. aaa aaa aaaa aaaaa. asdf asdf qwerty qwerty jkl jkl. foo bar baz qux.
Testo segnaposto. Inserire qui il testo. Qui va inserito il contenuto dell'articolo. Testo provvisorio, verrà sostituito. Titolo provvisorio.
Hier kommt der Text hin. Dies ist ein Blindtext. Platzhaltertext für das Layout. Der Text folgt in Kürze. Hier können Sie Ihren Text eingeben. Überschrift folgt.
Aquí va el texto. Texto de relleno. Inserte su texto aquí. Texto provisional que será sustituido. Título provisional de la noticia.
Insérez votre texte ici. Texte de remplissage. Ceci est un faux texte pour la maquette. Le texte définitif viendra plus tard. Titre provisoire.
Insira o seu texto aqui. Texto de preenchimento. Este texto é apenas um exemplo e deve ser substituído. Título provisório.
Plaats hier uw tekst. Opvultekst. Dit is voorbeeldtekst en wordt later vervangen. Tekst volgt nog. Voorlopige titel.
Введите текст здесь. Текст-заполнитель. Это пример текста, он будет заменён перед публикацией. Здесь будет ваш текст. Заголовок появится позже.
"""

# Seeds of error messages and demands for scripts (what common servers, proxies, frameworks and browsers say).
NOTICES = """
The requested URL was not found on this server. Error 404: the requested page does not exist. We can't find the page you're looking for. The page may have been removed, had its name changed, or be temporarily unavailable. Sorry, this page doesn't exist. There is nothing here. You may have mistyped the address. Go back to the home page or use the search box.
403 Forbidden. You don't have permission to access this resource. Access to this page has been denied. You are not authorized to view this page. Access is denied for your address. Reference number. Reference ID.
500 Internal Server Error. The server encountered an internal error and was unable to complete your request. Oops, an error occurred. Something has gone wrong. Well, this is embarrassing: something broke on our side. We have logged the incident. Please contact the server administrator.
502 Bad Gateway. The proxy server received an invalid response from an upstream server. 503 Service Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later. 504 Gateway Time-out. The gateway did not receive a timely response from the upstream server. The host is not responding. The connection timed out.
429 Too Many Requests. You have sent too many requests in a given amount of time. Rate limit exceeded. Please slow down and wait a few seconds before you reload the page. We have detected unusual traffic from your network.
Error connecting to the database. A database error occurred. The database server is not available. Unable to connect to the database host. Could not establish a connection.
Fatal error: Uncaught exception thrown in index.php on line. Fatal error: Call to undefined function in on line. Fatal error: Allowed memory size exhausted. Warning: include(): Failed opening file for inclusion in on line. Warning: failed to open stream: No such file or directory in on line. Notice: Undefined variable in on line. Parse error: syntax error, unexpected token on line.
Traceback (most recent call last): File, line, in module. TemplateDoesNotExist at. Exception: NullPointerException. Exception in thread main. Stack trace. Timeout while loading this block. Error rendering component. Error loading the article. The content could not be displayed. Failed to load the rest of this story. Unable to load content. Error code. Ray ID. Request ID. Trace ID. Incident ID.
The site is under maintenance. We'll be back soon. Sorry for the inconvenience, we are performing scheduled maintenance at the moment. Briefly unavailable for scheduled maintenance. Check back in a minute. This website is temporarily offline.
Your session has timed out. You have been logged out due to inactivity. Please log in again. Sorry, this content isn't available in your country. This video can't be played. This material is blocked in your area for legal reasons.
Just a moment. Checking if the site connection is secure. Please wait while your browser is being checked. This process is automatic and takes up to five seconds. You will be redirected shortly. Verify that you are a human. Complete the security check to access the site. Loading.
JavaScript is disabled. You need to enable JavaScript to run this app. This site requires JavaScript to work. JavaScript seems to be disabled in your browser. For full functionality of this site it is necessary to enable JavaScript. Enable scripts and cookies to continue, then reload. Turn on scripting in the settings of your browser. Scripts are blocked, so the page cannot be shown. Your browser does not support scripts. Please switch to a supported browser. The rest of this page needs scripts.
Pagina non trovata. Errore 404. La pagina che cerchi non esiste o è stata rimossa. Accesso negato: non hai i permessi per vedere questa pagina. Errore interno del server. Si è verificato un errore, riprova tra qualche minuto. Servizio temporaneamente non disponibile. Il sito è in manutenzione, torna a trovarci più tardi. Torna alla pagina iniziale. Sessione scaduta, effettua di nuovo l'accesso. Codice di errore. Impossibile caricare il contenuto.
Per visualizzare la pagina è necessario abilitare JavaScript. Gli script sono disattivati nel tuo browser: attivali e ricarica la pagina. Questo sito richiede JavaScript.
Página no encontrada. Error 404. La página que busca no existe o ha sido eliminada. Acceso denegado: no tiene permiso para ver esta página. Error interno del servidor. Se ha producido un error, vuelva a intentarlo en unos minutos. Servicio temporalmente no disponible. El sitio está en mantenimiento. Volver a la página de inicio. Su sesión ha expirado, inicie sesión de nuevo. Código de error. No se pudo cargar el contenido.
Para ver esta página es necesario activar JavaScript. Los scripts están desactivados en su navegador: actívelos y recargue la página. Este sitio requiere JavaScript.
Page non trouvée. Erreur 404. La page que vous recherchez n'existe pas ou a été supprimée. Accès refusé : vous n'avez pas l'autorisation de consulter cette page. Erreur interne du serveur. Une erreur s'est produite, veuillez réessayer dans quelques minutes. Service temporairement indisponible. Le site est en cours de maintenance. Retour à l'accueil. Votre session a expiré, reconnectez-vous. Code d'erreur. Impossible de charger le contenu.
Pour afficher cette page, vous devez activer JavaScript. Les scripts sont désactivés dans votre navigateur : activez-les et rechargez la page. Ce site nécessite JavaScript.
Seite nicht gefunden. Fehler 404. Die gesuchte Seite existiert nicht oder wurde entfernt. Zugriff verweigert: Sie haben keine Berechtigung, diese Seite anzuzeigen. Interner Serverfehler. Ein Fehler ist aufgetreten, bitte versuchen Sie es in einigen Minuten erneut. Der Dienst ist vorübergehend nicht verfügbar. Die Website wird gerade gewartet. Zurück zur Startseite. Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an. Fehlercode. Der Inhalt konnte nicht geladen werden.
Um diese Seite anzuzeigen, müssen Sie JavaScript aktivieren. Skripte sind in Ihrem Browser deaktiviert: Schalten Sie sie ein und laden Sie die Seite neu. Diese Website benötigt JavaScript.
Página não encontrada. Erro 404. A página que procura não existe ou foi removida. Acesso negado: não tem permissão para ver esta página. Erro interno do servidor. Ocorreu um erro, tente novamente dentro de alguns minutos. Serviço temporariamente indisponível. O site está em manutenção. Voltar à página inicial. A sua sessão expirou, inicie sessão novamente. Código de erro. Não foi possível carregar o conteúdo.
Para ver esta página é necessário ativar o JavaScript. Os scripts estão desativados no seu navegador: ative-os e recarregue a página. Este site requer JavaScript.
Pagina niet gevonden. Fout 404. De gezochte pagina bestaat niet of is verwijderd. Toegang geweigerd: u hebt geen rechten om deze pagina te bekijken. Interne serverfout. Er ging iets mis, probeer het over enkele minuten opnieuw. De dienst is tijdelijk niet beschikbaar. Deze website is in onderhoud. Terug naar de startpagina. Uw sessie is verlopen, meld u opnieuw aan. Foutcode. De inhoud kan niet worden geladen.
Om deze pagina te zien moet u JavaScript inschakelen. Scripts zijn uitgeschakeld in uw browser: zet ze aan en laad de pagina opnieuw. Deze site vereist JavaScript.
Страница не найдена. Ошибка 404. Запрашиваемая страница не существует или была удалена. Доступ запрещён: у вас нет прав на просмотр этой страницы. Внутренняя ошибка сервера. Произошла ошибка, повторите попытку через несколько минут. Сервис временно недоступен. На сайте ведутся технические работы. Вернуться на главную страницу. Время сеанса истекло, войдите снова. Код ошибки. Не удалось загрузить содержимое.
Чтобы просмотреть эту страницу, необходимо включить JavaScript. Скрипты отключены в вашем браузере: включите их и перезагрузите страницу. Для работы сайта требуется JavaScript.
"""

# Examples of what sites put around articles, which is no residue and is held against it like natural text.
FURNITURE = """
Share this article. Print this page. Click here to print this page. Listen to this article (3 min). Save this story. Advertisement. Story continues below. Comments are closed on this story. Log in to leave a comment. 12 comments so far. Read also: Related: More on this: Most read today: Follow us for more. Subscribe to keep reading. Sign up for the newsletter. Enter your email address to receive alerts. You can unsubscribe whenever you like. We use cookies. You can change your choice at any time. Accept all or manage preferences. Photo: Copyright. All rights reserved. Terms of use, privacy notice and complaints procedure. By our staff. is a correspondent based in. Reach through the desk.
This website and its partners store information on your device, such as cookies. You can withdraw your consent in the privacy settings. All content of this service is protected by copyright. It may not be copied, stored or passed on without the written permission of the publisher. Sign in or create a free account to go on reading. Already a subscriber? Get our best stories by email each morning. Have a tip? Write to the newsroom.
Questo sito e i suoi partner conservano informazioni sul tuo dispositivo. Puoi revocare il consenso nelle impostazioni. Tutti i contenuti sono protetti dal diritto d'autore e non possono essere copiati senza il permesso scritto dell'editore. Accedi o registrati per continuare a leggere.
Este sitio y sus socios guardan información en su dispositivo. Puede retirar su consentimiento en los ajustes. Todos los contenidos están protegidos por derechos de autor y no pueden copiarse sin el permiso escrito del editor. Inicie sesión o regístrese gratis para seguir leyendo.
Ce site et ses partenaires conservent des informations sur votre appareil. Vous pouvez retirer votre consentement dans les réglages. Tous les contenus sont protégés par le droit d'auteur et ne peuvent être copiés sans l'accord écrit de l'éditeur. Connectez-vous ou créez un compte gratuit pour lire la suite.
Diese Website und ihre Partner speichern Informationen auf Ihrem Gerät. Sie können Ihre Einwilligung in den Einstellungen widerrufen. Alle Inhalte sind urheberrechtlich geschützt und dürfen ohne schriftliche Zustimmung des Verlags nicht kopiert werden. Melden Sie sich an, um weiterzulesen.
Este site e os seus parceiros guardam informações no seu dispositivo. Pode retirar o consentimento nas definições. Todos os conteúdos estão protegidos por direitos de autor e não podem ser copiados sem autorização escrita do editor. Entre ou registe-se para continuar a ler.
Deze website en haar partners bewaren informatie op uw apparaat. U kunt uw toestemming intrekken bij de instellingen. Alle inhoud is auteursrechtelijk beschermd en mag zonder schriftelijke toestemming van de uitgever niet worden gekopieerd. Log in of maak een gratis account om verder te lezen.
Этот сайт и его партнёры хранят информацию на вашем устройстве. Вы можете отозвать согласие в настройках. Все материалы защищены авторским правом, их нельзя копировать без письменного согласия издателя. Войдите или зарегистрируйтесь, чтобы читать дальше.
Condividi questo articolo. Stampa questa pagina. Ascolta l'articolo (3 min). Pubblicità. I commenti sono chiusi. Leggi anche: Sullo stesso tema: I più letti: Usiamo i cookie. Iscriviti alla newsletter. Abbonati per continuare a leggere. Foto di. Riproduzione vietata.
Comparta esta noticia. Imprimir esta página. Escuche esta noticia (3 min). Publicidad. Los comentarios están cerrados. Lea también: Más sobre este tema: Lo más leído: Usamos cookies. Suscríbase para seguir leyendo. Todos los derechos reservados. Foto de. Por.
Partager cet article. Imprimer cette page. Écouter l'article (3 min). Publicité. Les commentaires sont fermés. Lire aussi : Sur le même sujet : Les plus lus : Nous utilisons des cookies. Abonnez-vous pour lire la suite. Tous droits réservés. Photo de. Par.
Artikel teilen. Seite drucken. Artikel anhören (3 Min). Anzeige. Die Kommentare sind geschlossen. Lesen Sie auch: Mehr zum Thema: Meistgelesen: Wir verwenden Cookies. Mit einem Abo lesen Sie weiter. Alle Rechte vorbehalten. Foto von. Von.
Compartilhe esta notícia. Imprimir esta página. Ouça esta notícia (3 min). Publicidade. Os comentários estão encerrados. Leia também: Mais sobre este tema: Mais lidas: Usamos cookies. Assine para continuar a ler. Todos os direitos reservados. Foto de. Por.
Deel dit artikel. Pagina afdrukken. Luister naar dit artikel (3 min). Advertentie. Reageren is niet meer mogelijk. Lees ook: Meer over dit onderwerp: Meest gelezen: Wij gebruiken cookies. Neem een abonnement om verder te lezen. Alle rechten voorbehouden. Foto van. Door.
Поделиться статьёй. Распечатать страницу. Слушать статью (3 мин). Реклама. Комментарии закрыты. Читайте также: По теме: Самое читаемое: Мы используем файлы cookie. Подпишитесь на рассылку. Все права защищены. Фото.
"""

# Field names and forms of placeholders, from which examples of unfilled ones are built, and what stands for a missing value.
FIELDS = "name title first_name headline body date city amount author image item count".split()
MARKS = ["{{{{{0}}}}}", "{{{{ {0} }}}}", "{{{{ page.{0} }}}}", "{{{{ page.{0} | safe }}}}", "${{{0}}}", "$({0})", "${0}$", "<%= {0} %>", "<%= page.{0} %>", "%%{1}%%", "%{0}$s", "%{0}%", "%({0})s", "[[{0}]]", "(({0}))", "__{1}__", "@@{0}@@", "#{0}#", "[INSERT {1}]", "[{0} tk]", "[{1} HERE]", "{{{0}}}", "{{% {0} %}}", "{{0}}", "{{1}}"]
VALUES = ["TKTK", "[object Object]", "null null", "undefined", "NaN NaN"]

_QUOTED = re.compile(r"\"[^\"\n]{0,400}?\"|“[^”\n]{0,400}?”|„[^“”\n]{0,400}?[“”]|«[^»\n]{0,400}?»|”[^”\n]{0,400}?”")
_LETTER, _DIGIT = 97, 48


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case characters of the texts between newlines and the places of the newlines. A number, and a word of four or more characters
    that has a digit (a code), is one digit."""
    joined = "\n" + "\n".join(t.replace("\n", " ") if "\n" in t else t for t in texts) + "\n"
    low = joined.lower()
    code = np.frombuffer((low if len(low) == len(joined) else joined).encode("utf-32-le", "surrogatepass"), "uint32").copy()
    digit = (code >= 48) & (code <= 57)
    code[digit] = _DIGIT
    word = digit | ((code >= 97) & (code <= 122))
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, after = edge[::2], edge[1::2]
    upto = np.cumsum(digit, dtype="int32")
    held = upto[after - 1] - upto[first - 1]
    some = (held > 0) & ((after - first >= 4) | (held == after - first)) & (after - first > 1)
    if some.any():
        first, after = first[some], after[some]
        code[first] = _DIGIT
        inside = np.zeros(len(code) + 1, "int8")
        inside[first + 1] += 1
        inside[after] -= 1
        code = code[np.cumsum(inside[:-1], dtype="int8") == 0]
    return code, np.flatnonzero(code == 10)


def _letters() -> np.ndarray:
    code = np.arange(1 << 16, dtype="uint32")
    return np.where(((code >= 97) & (code <= 122)) | (code >= 0xC0) & ((code < 0x2000) | (code > 0x206F)), np.uint32(_LETTER), code)


#: What a character is in an outline; those beyond the table are letters like its last.
_OUTLINE = _letters()


def _outline(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The punctuation of texts: runs of letters, of digits and of blanks count as one character each; and the places of the newlines."""
    code = _OUTLINE[np.minimum(code, 0xFFFF)]
    run = (code == _LETTER) | (code == _DIGIT) | (code == 32)
    kept = np.ones(len(code), bool)
    kept[1:] = (code[1:] != code[:-1]) | ~run[1:]
    code = code[kept]
    return code, np.flatnonzero(code == 10)


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters that end at each place (the first places hold fewer)."""
    h = code.copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h[k:] ^= code[:-k] * np.uint32(0x9E3779B1 + 2 * k)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


@dataclass
class Models:
    """Log likelihood ratios by hashed n-gram against natural text: ``text`` for filler and notices, ``values`` for what stands for a missing
    value (both over characters), ``marks`` for placeholders (over the outline)."""

    text: np.ndarray
    values: np.ndarray
    marks: np.ndarray
    mean: float = SURE

    def covered(self, texts: list[str]) -> np.ndarray:
        """The share of each text that lies in windows of high ratio of filler or notices."""
        return self._scan(texts)[0]

    def marked(self, texts: list[str]) -> np.ndarray:
        """Whether a text has a placeholder outside quotation marks: a window of high ratio of placeholders or missing values."""
        return self._scan(texts)[1]

    def residue(self, texts: list[str], least: float = 0.5) -> np.ndarray:
        share, marked = self._scan(texts)
        return (share >= least) | marked

    def _scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0), np.zeros(0, bool)
        parts = [self._scan_chunk(part) for part in _chunks(texts)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])

    def _scan_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code, line = _codes(texts)
        grams = _grams(code, 5)
        hot = _windows(_within(self.text[grams], line, 5), line, WINDOW, self.mean)
        upto = np.concatenate([[0], np.cumsum(hot, dtype="int32")])
        share = (upto[line[1:]] - upto[line[:-1]]) / np.maximum(np.diff(line) - 1, 1)
        marked = self._marks(code, line, grams)
        again = np.flatnonzero(marked)
        if len(again):  # those that have none left without what they quote only report on it
            code, line = _codes([_QUOTED.sub(" ", texts[i]) for i in again])
            marked[again] = self._marks(code, line, _grams(code, 5))
        return share, marked

    def _marks(self, code: np.ndarray, line: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Texts with a window of ``VALUE_WINDOW`` high values or of two high outlines."""
        out = _reached(_within(self.values[grams], line, 5), line, VALUE_WINDOW, VALUE_WINDOW * 3.5)
        outline, at = _outline(code)
        return out | _reached(_within(self.marks[_grams(outline, 3)], at, 3), at, 2, OUTLINES)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in parts of about ``CHUNK`` characters; no measure of a text depends on the others."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _within(lr: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Ratios of n-grams, 0 where they reach into the text before, which must not tell on a text."""
    for k in range(n - 1):
        lr[np.minimum(line + k, len(lr) - 1)] = 0.0
    return lr


def _peaks(lr: np.ndarray, line: np.ndarray, width: int) -> np.ndarray:
    """The highest sum of ``width`` successive ratios in each text, or of those that are left of it."""
    sums = np.concatenate([[0.0], np.cumsum(lr, dtype="float64")])
    place = np.arange(line[-1])
    end = np.minimum(place + width, np.repeat(line[1:], np.diff(line)))
    return np.maximum.reduceat(sums[end] - sums[place], line[:-1])


def _reached(lr: np.ndarray, line: np.ndarray, width: int, least: float) -> np.ndarray:
    """Whether the peak of a text is at least ``least``. A sum of at most ``width`` ratios can't be if none of them has its share of it, so
    only texts with such a ratio are gone through."""
    out = np.zeros(len(line) - 1, bool)
    high = np.flatnonzero(lr >= np.float32(least / width * (1 - 1e-6)))
    if len(high):
        some = np.unique(np.searchsorted(line, high, "right") - 1)
        some = some[some < len(out)]
        if len(some):
            length = line[some + 1] - line[some]
            own = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(own[-1]) + np.repeat(line[some] - own[:-1], length)
            out[some] = _peaks(lr[place], own, width) >= least
    return out


def _windows(lr: np.ndarray, line: np.ndarray, width: int, mean: float) -> np.ndarray:
    """Places that lie in a window of ``width`` inside one text, or in a whole text that is shorter, whose mean ratio is at least ``mean``."""
    edge = np.zeros(len(lr) + 1, "int32")
    sums = np.concatenate([[0.0], np.cumsum(lr, dtype="float64")])
    length = np.diff(line) - 1
    short = np.flatnonzero((length > 0) & (length < width))
    first, after = line[short] + 1, line[short + 1]
    whole = sums[after] - sums[first] >= mean * np.maximum(length[short] - 3, width // 2)  # 5-grams of the text, half a window of them at least
    edge[first[whole]] += 1
    edge[after[whole]] -= 1
    if len(lr) > width:
        start = np.flatnonzero(sums[width:] - sums[:-width] >= mean * width)
        start = start[np.searchsorted(line, start) == np.searchsorted(line, start + width)]
        edge[start] += 1
        edge[start + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def _frequencies(texts: list[str], n: int, outline: bool = False) -> np.ndarray:
    code, _ = _codes(texts)
    if outline:
        code, _ = _outline(code)
    f = np.bincount(_grams(code, n)[code != 10], minlength=1 << BITS).astype("float64")
    return f / max(1.0, f.sum())


def _inner(code: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """The hashed n-grams of texts, without those that reach into the text before, so the order of texts does not matter."""
    inside = np.ones(len(code), bool)
    for k in range(n - 1):
        inside[np.minimum(line + k, len(code) - 1)] = False
    return _grams(code, n)[inside]


def _tally(texts: list[str], n: int, outline: bool = False) -> np.ndarray:
    """How often each hashed n-gram stands in texts."""
    code, line = _codes(texts)
    if outline:
        code, line = _outline(code)
    return np.bincount(_inner(code, line, n), minlength=1 << BITS)


def _both_tallies(texts: list[str]) -> np.ndarray:
    """``_tally`` of 5-grams and of 3-grams of the outline, texts being coded once."""
    five, three = [], []
    for part in _chunks(texts):
        code, line = _codes(part)
        five.append(_inner(code, line, 5))
        three.append(_inner(*_outline(code), 3))
    return np.stack([np.bincount(np.concatenate(x), minlength=1 << BITS) for x in (five, three)])


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / max(1.0, counts.sum())


def _ratio(of: np.ndarray, natural: np.ndarray, floor: float, most: float = 4.0) -> np.ndarray:
    r = np.log((of + floor) / (natural + floor))
    return np.clip(r, -most, most).astype("float32")


def _examples(seeds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Frequencies of what seeds and the corpus show, each with half the weight: what few paragraphs show is not drowned out as the corpus grows."""
    return (_share(seeds) + _share(found)) / 2 if found.any() else _share(seeds)


def _sentences(block: str) -> list[str]:
    return [s + "." for line in block.strip().split("\n") for s in re.split(r"(?<=[.!?:]) ", line) if s.strip(" .")]


def fit(sample: list[str], short: list[str] | None = None, rounds: int = 3) -> Models:
    """Models fitted in rounds. The first knows the seeds only. In each next round, contents of ``sample`` and ``short`` most of whose text the
    last models cover add the paragraphs that show some of it to the examples, so what the corpus itself shows in place of articles is
    learned from it; paragraphs of ``sample`` that they give to residue are left out of the natural text."""
    seeds, around = _sentences(FILLER) + _sentences(NOTICES), _frequencies(_sentences(FURNITURE), 5)
    marks = [" " + m.format(f, f.upper()) + " " for m in MARKS for f in FIELDS]
    values = [f" {v} " for v in VALUES]
    texts = [own for own in map(paragraphs, [*sample, *(short or [])]) if own]
    natural = [p for c in sample for p in paragraphs(c)]
    found: list[str] = []
    out = None
    for _ in range(rounds):
        base5 = _frequencies(natural, 5) if natural else np.zeros(1 << BITS)
        outline = _frequencies(natural, 3, True) if natural else np.zeros(1 << BITS)
        out = Models(
            _ratio(_frequencies(seeds + found, 5), base5 + around, 2e-6), _ratio(_frequencies(values, 5), base5, 2e-6), _ratio(_frequencies(marks, 3, True), outline, 2e-6, 9.0)
        )
        natural = [p for p, bad in zip(natural, out.residue(natural, 0.4)) if not bad]
        share = iter(out.covered([p for own in texts for p in own]))
        found = []
        for own in texts:
            held = [(p, next(share)) for p in own]
            if sum(len(p) * x for p, x in held) >= LEARN * sum(map(len, own)):
                found += [p for p, x in held if x >= LEARN / 2]
        found = sorted(set(found))
    out.mean = MEAN
    return out


_TALLIED = "kind int, slice int, counts binary, text string"
_TALLIED_ARROW = pa.schema([("kind", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary()), ("text", pa.string())])


def _tallied(models: Models | None):
    """Over contents: counts of all paragraphs (without models), else of those that the models give to residue, as slices of vectors (5-grams are
    kind 0, 3-grams of the outline kind 1), and the paragraphs that contents covered by the models teach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), "int64")
        texts, ends, size = [], [], 0

        def flush() -> list[str]:
            nonlocal texts, ends, size
            some, found = texts, set()
            if models is not None:
                share, marked = models._scan(texts)
                some = [p for p, x, m in zip(texts, share, marked) if x >= 0.4 or m]
                for a, e in zip([0, *ends], ends):
                    held = list(zip(texts[a:e], share[a:e]))
                    if held and sum(len(p) * x for p, x in held) >= LEARN * sum(len(p) for p, _ in held):
                        found.update(p for p, x in held if x >= LEARN / 2)
            if some:
                total[:] += _both_tallies(some)
            texts, ends, size = [], [], 0
            return sorted(found)

        def told(found: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"text": t} for t in found], _TALLIED_ARROW)

        for batch in batches:
            for content in batch.column(0):
                own = paragraphs(content.as_py())
                texts += own
                ends.append(len(texts))
                size += sum(map(len, own))
                if size > HELD:
                    yield told(flush())
        yield told(flush())
        for kind in (0, 1):
            for k in range(0, 1 << BITS, SLICE):
                if (part := total[kind, k : k + SLICE]).any():
                    yield pa.RecordBatch.from_pylist([{"kind": kind, "slice": k // SLICE, "counts": part.tobytes()}], _TALLIED_ARROW)

    return run


def _example_tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, "int64")
    for batch in batches:
        if batch.num_rows:
            total += _tally(batch.column(0).to_pylist(), 5)
    for k in range(0, 1 << BITS, SLICE):
        if (part := total[k : k + SLICE]).any():
            yield pa.RecordBatch.from_pylist([{"kind": 0, "slice": k // SLICE, "counts": part.tobytes()}], _TALLIED_ARROW)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            part, at = np.frombuffer(r["counts"], "int64"), (r["kind"], r["slice"])
            total[at] = total[at] + part if at in total else part
    rows = [{"kind": kind, "slice": k, "counts": part.tobytes()} for (kind, k), part in total.items()]
    yield pa.RecordBatch.from_pylist(rows, _TALLIED_ARROW)


def _total(tallied: DataFrame) -> np.ndarray:
    """The sums of slices of counts of all tasks; two vectors of 2 MB come to the driver, whatever the number of contents."""
    out = np.zeros((2, 1 << BITS), "int64")
    for r in tallied.filter("counts is not null").repartition("kind", "slice").mapInArrow(_added, _TALLIED).collect():
        out[r.kind, r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, "int64")
    return out


def learn(extracted: DataFrame, rounds: int = 3) -> Models:
    """Models fitted in rounds like those of ``fit``, on all contents: n-grams are counted in tasks, and of what the contents that the last models
    cover teach, each paragraph counts once; all of it together weighs as much as the seeds. Natural text is all but the paragraphs that the last models give to residue."""
    contents = extracted.filter("content is not null").select("content")
    seeds = _frequencies(_sentences(FILLER) + _sentences(NOTICES), 5)
    around = _frequencies(_sentences(FURNITURE), 5)
    marks = _frequencies([" " + m.format(f, f.upper()) + " " for m in MARKS for f in FIELDS], 3, True)
    values = _frequencies([f" {v} " for v in VALUES], 5)
    everything = natural = _total(durable(contents.mapInArrow(_tallied(None), _TALLIED)))
    found = np.zeros(1 << BITS, "int64")
    for k in range(rounds):
        base5 = _share(natural[0])
        out = Models(_ratio(_examples(seeds, found), base5 + around, 2e-6), _ratio(values, base5, 2e-6), _ratio(marks, _share(natural[1]), 2e-6, 9.0))
        if k < rounds - 1:
            told = durable(contents.mapInArrow(_tallied(out), _TALLIED))
            natural = everything - _total(told)
            found = _total(durable(told.filter("text is not null").select("text").distinct().mapInArrow(_example_tally, _TALLIED)))[0]
    out.mean = MEAN
    return out


def _judged(models: Models, from_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, owner, held = batch.column(0).to_pylist(), [], [], 0
            flagged: set[int] = set()

            def flush() -> None:
                nonlocal texts, owner, held
                for k in np.flatnonzero(models.residue(texts)):
                    flagged.add(owner[k])
                texts, owner, held = [], [], 0

            for i, value in enumerate(batch.column(1)):
                if from_html:
                    ps, rest = parse(value.as_py())
                    own = [t for t, _ in ps if t] or ([rest] if rest else [])
                else:
                    own = paragraphs(value.as_py())
                texts += own
                owner += [i] * len(own)
                held += sum(map(len, own))
                if held > HELD:
                    flush()
            flush()
            found = sorted({ids[i] for i in flagged if ids[i] is not None})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["page_id"])

    return run


def residue_pages(pages: DataFrame, extracted: DataFrame, models: Models | None = None) -> DataFrame:
    """(page_id) of pages whose text has residue where the article, or a part of it, should stand: judged on content, or on the html
    body (p elements, else the other text) of pages without a row in ``extracted``. A row with null or empty content has no residue.
    Repeated rows are listed once; empty tables give an empty result."""
    models = models or learn(extracted)
    by_content = extracted.select("page_id", "content").mapInArrow(_judged(models, False), "page_id long")
    missing = durable(pages.select("page_id").join(extracted.select("page_id"), "page_id", "left_anti"))
    alone = pages.select("page_id", "html").join(missing, "page_id", "left_semi")
    return by_content.union(alone.mapInArrow(_judged(models, True), "page_id long")).distinct()
