"""Patterns of residue, expanded into examples of each class (fixed values).

A line is a pattern; (a|b|c) stands for one of its parts. Expanding a pattern gives every combination, so the models learn
the words and word joints of a class rather than whole wordings.
"""

from __future__ import annotations

import re
from itertools import product

FILLER = """
(lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit) (sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua) (vestibulum|ante|primis|in|faucibus|orci|luctus|ultrices|posuere|cubilia|curae)
(pellentesque|habitant|morbi|tristique|senectus|netus|malesuada|fames|ac|turpis|egestas) (vivamus|suscipit|tortor|eget|felis|porttitor|volutpat|curabitur|aliquet|quam|id|dui) (nulla|quis|lorem|libero|nec|nisl|ligula|sapien|massa|vitae|nunc|mauris)
(donec|praesent|vestibulum|proin|aenean|phasellus|maecenas|integer|etiam|fusce) (sollicitudin|molestie|malesuada|pretium|placerat|tincidunt|accumsan|ullamcorper|pulvinar|venenatis|hendrerit) (eros|augue|diam|odio|risus|tellus|lectus|metus|sem|justo)
(Here comes|This is|Here goes|Here is|Insert) (the|some|your|only|just some) (body text|filler text|dummy text|dummy copy|placeholder copy|placeholder text|sample text|body copy|example text|final text|main text)
(This|The following) (paragraph|text|sentence|section|copy|block) is (only|just|merely|simply) (a stand-in|a placeholder|a filler|filler|dummy text|temporary|sample copy|an example) (and will be replaced|to be replaced later|until the final copy arrives|so that the layout can be judged|for the layout|for layout purposes|for the mock-up|and will be exchanged|and has no meaning)
(test|testing|sample|example|dummy|filler|placeholder) (test|testing|one two three|text|copy|content|words|paragraph|line) (test|text|copy|here|only|content)
(blah|bla|xxx|xxxx|yada|foo|bar|asdf|qwer|zxcv|qwerty|asdfasdf|abc|aaa|hjkl|fghj|test) (blah|bla|xxx|xxxxx|yada|foo|baz|asdf|qwer|zxcv|zxcvzxcv|qwerqwer|abc|bbb|hjkl|dfgh|test) (blah|bla|xxx|xxxx|yada|bar|asdf|qwerty|zxcv|abc|ccc|jkl|test)
(Aquí|Aqui) (irá|va|vendrá|se pondrá|iría) (el texto|el texto definitivo|el texto final|el contenido|el contenido definitivo)
Este (párrafo|texto|bloque) es (un simple|sólo un|solo|solamente|un mero) (relleno|texto de relleno|texto provisional|marcador|ejemplo|texto de prueba) (hasta que llegue el texto final|para la maqueta|que será sustituido|y será reemplazado|sin significado|provisional)
(prueba|texto|relleno|ejemplo|palabra) (prueba|texto|relleno|ejemplo|palabra) (prueba|texto|de relleno|de prueba)
(Ici|Ici viendra|Ici se trouvera|Insérer ici) (le texte|le texte définitif|le vrai texte|le texte final|le contenu|un texte de remplacement)
Ce (paragraphe|texte|bloc) n'est qu'un (bouche-trou|texte provisoire|exemple|faux texte|texte de remplissage|texte factice) (en attendant le vrai texte|qui sera remplacé|pour la maquette|pour la mise en page|à remplacer)
(Hier steht|Hier folgt|Hier kommt|Hier entsteht|Dies ist) (nur ein|nur|später|bald|lediglich ein) (Beispielabsatz|Beispieltext|Blindtext|Platzhalter|Fülltext|Mustertext|der endgültige Text|der eigentliche Text) (der später ersetzt wird|für das Layout|für den Satz|und wird noch ersetzt|ohne Bedeutung|bis der richtige Text kommt)
(Noch mehr|Ein|Nur|Etwas) (Blindtext|Fülltext|Mustertext|Platzhaltertext) (für das Layout|für den Entwurf|als Beispiel|zum Test)
(Aqui|Aqui ficará|Aqui entrará|Aqui vai|Aqui virá) (o texto|o texto final|o texto definitivo|o conteúdo|o conteúdo final)
Este (parágrafo|texto|bloco) é (apenas|só|somente) um (texto provisório|preenchimento|exemplo|texto de enchimento|marcador|texto fictício) (para a paginação|para o layout|que será substituído|e será trocado|sem significado)
Questo (paragrafo|testo|blocco) è (solo|soltanto|semplicemente) un (riempitivo|segnaposto|testo provvisorio|testo di prova|esempio) (in attesa del testo definitivo|per la prova di impaginazione|che verrà sostituito|per il layout|da sostituire)
(Testo segnaposto|Testo riempitivo|Testo provvisorio|Qui andrà il testo|Qui va il testo definitivo) (per la prova|per l'impaginazione|per il layout|da sostituire)
(Это|Здесь) (просто|только|лишь|будет) (заполняющий текст|текст-заполнитель|пример текста|временный текст|рыбный текст|текст для заполнения) (для макета|для макета страницы|который будет заменён|и будет заменён позже|без смысла)
(这里是|此处为|这是|以下为)(示例|占位|填充|样本|测试)(段落|文字|文本|内容)，(稍后|以后|之后|将来)(替换为|换成|改为|补充)(正式内容|正式文字|真实内容|正文)。
(これは|ここは|以下は)(仮の|ダミーの|サンプルの|見本の)(文章|テキスト|文|段落)です。(後で|あとで|のちに)(本文に|正式な文章に|実際の文に)(差し替えてください|差し替えます|置き換えます|入れ替えてください)。
(هذا|هنا) (النص|نص) (هو مثال لنص|مجرد نص|نص تجريبي|نص بديل|حشو) (يمكن أن يستبدل في نفس المساحة|سيتم استبداله لاحقا|مؤقت|لملء المساحة|لا معنى له)
(यह|यहाँ) (केवल|सिर्फ़|मात्र) (नमूना पाठ|भराव पाठ|उदाहरण पाठ|अस्थायी पाठ|परीक्षण पाठ) है (जिसे बाद में बदला जाएगा|जो बाद में बदलेगा|और इसका कोई अर्थ नहीं)
(นี่คือ|ตรงนี้เป็น)(ข้อความตัวอย่าง|ข้อความจำลอง|ข้อความชั่วคราว|ข้อความทดสอบ)(ที่จะถูกแทนที่ภายหลัง|สำหรับจัดหน้า|รอเนื้อหาจริง)
(Copy|Text|Words|Content|Body text|Main text|Story|Article|Summary) (to come|to follow|goes here|coming soon|will be added|to be inserted|will go here|pending). (Copy|Text|Words|Content) (to come|to follow|goes here|coming soon)
(Random|Meaningless|Nonsense|Invented|Made-up|Mock|Fake|Provisional|Stand-in|Temporary|Generic) (words|text|wording|copy|sentences|content|filler) (go in this box|to fill the column|to fill up the page|until the writer delivers|not for publication|for the design|only|to fill the space|to show the layout)
(sed ut|perspiciatis|unde omnis|iste natus|error sit|voluptatem|accusantium|doloremque|laudantium|totam rem|aperiam) (nemo enim|ipsam|quia|voluptas|aspernatur|aut odit|fugit|consequuntur|magni dolores|ratione|sequi nesciunt) (neque porro|quisquam|dolorem|adipisci velit|numquam eius|modi tempora|incidunt|magnam|aliquam|quaerat) (facilisi|cras|fermentum|feugiat|nibh|tempus|rhoncus|varius|dictum|lacinia|interdum|blandit|commodo)
(dfg|hjk|lkj|sdf|wer|rty|uio|vbn|mnb|poi|ghj|tyu) (dfg|hjk|lkj|sdf|wer|rty|uio|vbn|mnb|poi|ghj|tyu) (sdfg|hjkl|wert|yuio|xcvb|bnm|poiu|lkjh|dfgh) (fff|ggg|hhh|jjj|kkk|ddd|sss|ooo|nnn|mmm|xx|zz)
(Texto|Palabras|Contenido|Frases) (simulado|simuladas|de relleno|al azar|sin sentido|inventado|ficticias|provisional|genérico) (para llenar la columna|para rellenar el espacio|para ocupar la página|para el diseño|para la maqueta)
(Faux|Texte|Paragraphe|Contenu|Mots) (paragraphe|factice|au hasard|sans signification|provisoire|de remplissage|fictif|bidon) (servant à remplir la colonne|pour remplir l'espace|pour occuper la page|pour la maquette|pour combler)
(Nur|Irgendein|Sinnloser|Zufälliger|Vorläufiger) (Fülltext|Text|Platzhalter|Blindtext|Inhalt), (damit die Spalte nicht leer bleibt|um den Platz zu füllen|um die Seite zu füllen|für den Entwurf|ohne jeden Sinn)
(Palavras|Texto|Conteúdo|Frases) (de enchimento|ao acaso|sem sentido|provisório|fictício|inventadas|de teste) (para ocupar a coluna|para encher o espaço|para a maquete|para preencher a página)
(Parole|Testo|Contenuto|Frasi) (a caso|senza senso|provvisorio|inventate|fittizio|di riempimento) (per riempire la colonna|per occupare lo spazio|per la bozza|per il layout)
(Случайный|Бессмысленный|Временный|Условный) (текст|набор слов) (для заполнения колонки|для заполнения места|для макета|для примера)
(占位用的|填充用的|无意义的|随机的)(文字|文本|段落|内容)，(没有实际意义|仅用于排版|仅供测试|以填充版面)。
(レイアウト確認用の|スペースを埋めるための|意味のない|適当な)(ダミー文|文章|テキスト|仮文)(です|が入ります|を入れています)。
"""

ERROR_PAGE = """
(We're sorry, but the|Sorry, the|The|This|The requested|That) (page|site|website|document|file|resource|link|address|URL|item|view) (could not be found|cannot be found|was not found|isn't here|is not here|is not available|is no longer available|is temporarily unavailable|does not exist|doesn't exist|no longer exists|has expired|has been removed|has moved|was moved|can't be reached|could not be loaded|could not be opened|could not be displayed|failed to load|is offline|is gone|is down)
(Unable|Failed|Not able|Could not|Cannot) (to establish|to open|to connect to|to reach|to resolve|to load|to read|to complete) (a database connection|the database|the server|the host|the host name|a connection|the page|the requested page|the file|the document|your request|the operation)
(The|This|A|Your) (operation|request|connection|session|query|server|host|gateway|upstream server|proxy|database|network|login|download|upload) (timed out|has timed out|failed|was refused|was rejected|was rejected by the server|was reset|was closed|was interrupted|has ended|has expired|did not respond|is not responding|returned an error|took too long|could not be completed|could not be processed|was aborted|is overloaded|is unreachable)
(timed out|timeout|time limit exceeded) (while|when) (waiting for a response|connecting|loading|reading) (from the host|from the server|from upstream|to the server)
(You|You currently|Sorry, you) (don't have|do not have|lack|need) (sufficient|enough|the required|the necessary|proper|administrator) (privileges|permissions|permission|rights|access rights|credentials) (to open|to view|to access|to read|to edit|for) (this|the|that) (resource|page|file|document|folder|area|action|site)
(HTTP|HTTP error|HTTP status|Error|Status|Code|Error code|Server error) (400|401|403|404|405|408|409|410|413|418|429|500|502|503|504): (bad request|unauthorized|forbidden|not found|method not allowed|request timeout|conflict|gone|payload too large|the request was rejected by the server|too many requests|internal server error|bad gateway|service unavailable|gateway timeout|malformed header|invalid request)
(Bad request|Invalid request|Request failed|Malformed request): (malformed header|invalid syntax|missing parameter|unknown host|invalid token|not supported)
(An|An unexpected|An internal|An unknown|A fatal|A server|A runtime|A system) (error|exception|failure|fault) (occurred|has occurred|was thrown|was encountered|happened) (while|when) (rendering|loading|processing|opening|handling|reading|displaying|saving) (this view|the page|your request|this page|the file|the document|the template|data)
(Fatal error|Error|Warning|Exception|Runtime error|Parse error|Unhandled exception|Stack trace): (uncaught exception|undefined variable|null reference|out of memory|unexpected token|invalid argument|permission denied|no such file or directory|connection refused|cannot read property) (in module loader|in line 0|at line 0|in module|on line 0|in template)
(DNS lookup|SSL handshake|TLS handshake|Name resolution|Certificate check|Authentication|Authorization|Login|Verification) (failed|error|timed out|failure): (the host name could not be resolved|the certificate is not valid|the certificate has expired|invalid credentials|unknown host|please contact the administrator|no route to host)
(The website|The site|The server|This service|The system|Our site) is (temporarily|currently|momentarily|now) (unable to service your request|unavailable|offline|down for maintenance|undergoing maintenance|overloaded|not reachable) (due to maintenance downtime|due to capacity problems|because of technical problems|due to high traffic|for scheduled maintenance)
(Please|Kindly) (try again|try again later|reload the page|refresh the page|go back|return to the home page|contact the administrator|contact the webmaster|contact support|check the address|check the URL|check your connection|log in again|sign in again|wait a moment and try again|ask the owner for a new link|ask the owner for a new one)
(Ask|Contact|Email) (the owner|the administrator|support|the webmaster|your administrator) (for a new link|for a new one|for access|for help|if the problem persists|if this continues)
(Oops|Whoops|Uh-oh|Sorry|Error)! (Something went wrong|Something broke|That didn't work|This page is missing|Nothing here|We hit a snag|An error occurred) (on our end|on our side|while loading|here)
(No se puede|No se pudo|No ha sido posible|No es posible|Imposible) (acceder a|abrir|cargar|mostrar|establecer|conectar con|encontrar|completar|leer) (este sitio web|este sitio|la página|el archivo|el documento|la conexión|la base de datos|el servidor|la solicitud|el recurso|la conexión con la base de datos) (en este momento|ahora|temporalmente)
(El|La) (recurso solicitado|página solicitada|documento solicitado|archivo|enlace|servidor|sitio|solicitud|conexión|operación|sesión) (fue eliminado|fue eliminada|ya no existe|no existe|no se ha encontrado|no se encuentra|no está disponible|ha caducado|ha expirado|ha fallado|fue rechazada|fue interrumpida|tardó demasiado|ha superado el tiempo de espera|ha superado el tiempo máximo de espera|no responde)
(Error de|Fallo de|Error en la|Fallo en la) (conexión|conexión con la base de datos|autenticación|red|servidor|carga|lectura|base de datos|solicitud)
(No dispone de|No tiene|Carece de|Necesita) (privilegios|permisos|derechos|autorización|credenciales|los permisos) (suficientes|necesarios|requeridos) (para abrir|para ver|para acceder a|para leer) (este recurso|esta página|este archivo|este documento)
(Vuelva a intentarlo|Inténtelo de nuevo|Recargue la página|Póngase en contacto con el administrador|Compruebe la dirección|Pida un enlace nuevo) (más tarde|en unos minutos|si el problema continúa)
(Impossible|Échec lors de la tentative|Il est impossible) (d'établir|d'ouvrir|d'afficher|de charger|de joindre|d'accéder à|de se connecter à|de lire|de trouver) (une connexion à la base de données|la connexion|la page|le fichier|le document|le serveur|la base de données|ce site|la ressource)
(Le lien|Le lien que vous avez suivi|La ressource demandée|La page demandée|Le document demandé|Le fichier|Le serveur|Le site|La session|La connexion|Cette opération|Votre requête) (a expiré|est introuvable|est introuvable sur ce serveur|n'existe plus|n'existe pas|n'est pas disponible|est indisponible|a été supprimé|a été supprimée|a échoué|a été refusée|a été interrompue|a pris trop de temps|a pris trop de temps et a été interrompue|ne répond pas|a été déplacée)
(Vous n'avez pas|Vous ne disposez pas|Il vous manque) (les droits|des droits|les autorisations|l'autorisation|des privilèges|les privilèges) (nécessaires|suffisants|requis) (pour ouvrir|pour consulter|pour accéder à|pour voir) (cette ressource|cette page|ce fichier|ce document)
(Erreur de|Échec de|Défaut de) (connexion|connexion à la base de données|chargement|lecture|réseau|serveur|authentification) (veuillez réessayer|réessayez plus tard|contactez l'administrateur)
Die (Verbindung|Verbindung zur Datenbank|Verbindung zum Server|Seite|Datei|angeforderte Seite|angeforderte Ressource|Ressource|Anfrage|Sitzung|Anmeldung|Übertragung) (konnte nicht hergestellt werden|konnte nicht geladen werden|konnte nicht gefunden werden|wurde nicht gefunden|wurde auf diesem Server nicht gefunden|wurde abgelehnt|wurde abgebrochen|wurde unterbrochen|wurde entfernt|wurde verschoben|ist abgelaufen|ist fehlgeschlagen|ist nicht verfügbar|ist nicht erreichbar|existiert nicht)
(Dieser Link|Der Link|Der Server|Dieser Dienst|Der Zugriff|Der Vorgang|Das Dokument|Die Datenbank) (ist abgelaufen|antwortet nicht|ist überlastet|ist nicht erreichbar|ist derzeit nicht verfügbar|wurde verweigert|wurde abgebrochen|wurde entfernt|hat zu lange gedauert|ist defekt)
(Für diese Aktion|Für diese Seite|Zum Öffnen dieser Datei|Für dieses Dokument) (fehlen Ihnen|haben Sie nicht|besitzen Sie nicht) (die nötigen|die erforderlichen|ausreichende|die notwendigen) (Rechte|Berechtigungen|Zugriffsrechte)
(Fehler|Fehler beim|Schwerer Fehler|Unbekannter Fehler|Interner Fehler) (beim Laden|beim Öffnen|beim Verbinden|aufgetreten|bei der Anmeldung|bei der Verbindung zur Datenbank|im Modul)
(Não foi possível|Não é possível|Impossível) (estabelecer|abrir|carregar|mostrar|aceder a|ligar a|encontrar|concluir|ler) (a ligação à base de dados|a ligação|a página|o ficheiro|o documento|o servidor|o pedido|este sítio|o recurso|a conexão com o banco de dados)
(O|A) (recurso solicitado|página solicitada|ficheiro|arquivo|documento|servidor|sítio|pedido|ligação|operação|sessão|base de dados) (não foi encontrado|não foi encontrado neste servidor|não foi encontrada|não existe|já não existe|não está disponível|foi removido|foi recusada|expirou|falhou|excedeu o tempo limite|não responde|demorou demasiado)
(Não tem|Não possui|Faltam-lhe) (permissões|privilégios|direitos|as permissões) (suficientes|necessárias|necessários) (para abrir|para ver|para aceder a) (este recurso|esta página|este ficheiro|este documento)
(Impossibile|Non è possibile|Non è stato possibile) (stabilire|aprire|caricare|mostrare|accedere a|connettersi a|trovare|completare) (una connessione con il database|la connessione|la pagina|il file|il documento|il server|la richiesta|questo sito)
(La|Il) (risorsa richiesta|pagina richiesta|documento richiesto|file|server|sito|richiesta|connessione|operazione|sessione|collegamento) (non è stata trovata|non è stata trovata su questo server|non è stato trovato|non esiste|non esiste più|non è disponibile|è scaduta|è scaduto|è stata rifiutata|è stata interrotta|non risponde|ha superato il tempo limite)
(Не удалось|Невозможно) (установить|открыть|загрузить|найти|выполнить|получить) (соединение с базой данных|соединение|страницу|файл|документ|запрос|ресурс|доступ к серверу)
(Страница|Запрошенная страница|Запрошенный ресурс|Файл|Сервер|Сеанс|Ссылка|Соединение|Документ) (не найдена|не найден|не найден на сервере|недоступен|недоступна|не отвечает|истёк|устарела|прервано|удалён|не существует)
(无法|不能|未能)(连接到|建立|打开|加载|找到|访问)(数据库|服务器|页面|文件|连接|该网址)，(请联系管理员|请稍后再试|请刷新页面|请检查网络|请重试)。
(请求的|您访问的|该)(页面|资源|文件|链接|地址)(不存在|未找到|已失效|已过期|已被删除|暂时无法访问|不可用)。
(データベース|サーバー|ページ|ファイル|リンク|ネットワーク)(に接続できませんでした|が見つかりませんでした|を読み込めませんでした|の有効期限が切れています|が応答しません|は利用できません|にアクセスできません|でエラーが発生しました)。
(تعذر|فشل|لا يمكن) (الاتصال|فتح|تحميل|العثور على|الوصول إلى) (بقاعدة البيانات|بالخادم|الصفحة|الملف|المستند|الموقع|المورد المطلوب)
(الصفحة|الخدمة|الرابط|الجلسة|الخادم) (غير موجودة|غير متاحة حاليا|منتهي الصلاحية|انتهت|لا يستجيب|غير متاح)
(डेटाबेस|सर्वर|पृष्ठ|फ़ाइल|लिंक) (से कनेक्शन स्थापित नहीं हो सका|नहीं मिला|उपलब्ध नहीं है|की समय सीमा समाप्त हो गई|लोड नहीं हो सका|प्रतिक्रिया नहीं दे रहा|मौजूद नहीं है)
(ไม่สามารถ)(เชื่อมต่อฐานข้อมูลได้|เชื่อมต่อเซิร์ฟเวอร์ได้|เปิดหน้านี้ได้|โหลดไฟล์ได้|ดำเนินการตามคำขอได้) (กรุณาลองใหม่ภายหลัง|โปรดติดต่อผู้ดูแลระบบ)
(Whoa|Hmm|Uh-oh|Oh no|Sorry|Yikes), (that address|this link|that page|this URL|the address you typed) (leads nowhere|is broken|goes nowhere|points to nothing|doesn't work|is not working|no longer works)
(We couldn't|We could not|We were unable to|We can't|We are unable to) (locate|find|retrieve|load|display|open|process|complete|verify) (the record|the page|the item|the document|the content|your account|your request|that file|the resource) (you asked for|you requested|you are looking for|you tried to open|at this address)
(Your|The|This) (token|password|username|account|licence|subscription|login|credential|API key|cookie|browser session|IP address) (is invalid|has been revoked|is wrong|was not recognised|has been suspended|has been blocked|has been locked|has been disabled|is incorrect|has expired|is not authorised|could not be verified)
(Maximum|Allowed|Too many|The maximum) (number of|) (retries|attempts|requests|connections|redirects|login attempts|downloads) (exceeded|has been exceeded|reached|was exceeded|from your address)
(Disk|Storage|Bandwidth|Memory|Request|Daily|Traffic) (quota|limit|space) (exceeded|reached|is full|has been exceeded) on the (remote host|server|account|device)
(The certificate|The signature|The response|The handshake|The header|The cookie|The token) (presented by the peer|sent by the server|received from upstream|of this site) (is not trusted|is not valid|is invalid|is missing|could not be verified|was malformed)
(Segmentation fault|Core dumped|Kernel panic|Stack overflow|Null pointer exception|Assertion failed|Broken pipe|Connection reset by peer|Access violation|Out of memory|Bus error|Traceback) (core dumped|in module|at address|most recent call last|process terminated|exit code)
(Backend|Upstream|Server|Gateway|Proxy|Origin|Endpoint|Service) (returned|responded with|answered with|sent) (status|error|code|an error code|an invalid response|an empty response) (500|502|503|504)
(Nothing|No page|No document|No resource|No file|No route|No results|No record) (matches|matched|exists at|was found at|found for|for) (the given URI|the given URL|this address|this path|that link|your request|the request)
(The proxy|The gateway|The load balancer|The web server|The application) (did not receive|received|could not get|failed to get) (a timely reply|no response|an invalid response|a reply in time|no data) from (the upstream server|the backend|the origin|the host)
We (are|are currently|seem to be) (experiencing|having|facing) (technical difficulties|technical problems|an outage|server problems|problems|some issues). (Our engineers|Our team|The team|Our technicians) (have been notified|has been informed|are working on it|is looking into it)
(This|The|Your) (account|user|profile|domain|site|page) (has been|is|was) (suspended|deactivated|deleted|banned|closed|locked|restricted|private)
(Esta|Su|La) (cuenta|contraseña|dirección|licencia|sesión|conexión) (ha sido suspendida|ha sido bloqueada|no es válida|ha sido desactivada|es incorrecta|no existe|no se reconoce|fue cerrada)
(Se ha superado|Se alcanzó|Se excedió) (el número máximo|el límite) de (intentos|solicitudes|conexiones|descargas|espacio)
(Estamos teniendo|Tenemos|Hay|Experimentamos) (problemas técnicos|dificultades técnicas|una avería|problemas con el servidor|una interrupción); (vuelva más tarde|disculpe las molestias|inténtelo luego|nuestro equipo trabaja en ello)
(Nous rencontrons|Nous avons|Il y a) (des difficultés techniques|des problèmes techniques|une panne|un problème avec le serveur)
(Le certificat|Le mot de passe|Votre compte|Ce compte|L'adresse|Le jeton|Le quota) (présenté n'est pas valide|est incorrect|a été suspendu|a été bloqué|n'existe pas|a été désactivé|est dépassé|est invalide|n'est pas reconnu)
(Le nombre maximal|La limite|Le quota) de (tentatives|requêtes|connexions|téléchargements) (a été dépassé|est atteint|est dépassée)
(Wir haben|Es gibt|Derzeit bestehen) (derzeit|leider|zurzeit) (technische Schwierigkeiten|technische Probleme|eine Störung|Probleme mit dem Server)
(Die maximale Anzahl|Die zulässige Anzahl|Das Limit) von (Versuchen|Anfragen|Verbindungen|Anmeldungen) (wurde überschritten|ist erreicht|ist überschritten)
(Dieses|Ihr|Das) (Konto|Passwort|Zertifikat|Benutzerkonto|Token) (wurde gesperrt|wurde gelöscht|ist ungültig|ist falsch|wurde deaktiviert|ist nicht gültig|wurde nicht erkannt)
(Estamos com|Temos|Há) (dificuldades técnicas|problemas técnicos|uma avaria|problemas no servidor). (Volte mais tarde|Pedimos desculpa)
(Esta|A sua|A) (conta|palavra-passe|senha|licença|sessão) (foi suspensa|foi bloqueada|é inválida|está incorreta|foi desativada|não existe)
(Stiamo riscontrando|Abbiamo|Ci sono) (problemi tecnici|difficoltà tecniche|un guasto|problemi con il server)
(Questo|Il suo|Il) (account|certificato|token|profilo|limite di tentativi) (è stato sospeso|è stato bloccato|non è valido|è stato disattivato|è stato superato)
(Превышено|Истекло|Превышен) (время ожидания ответа|число попыток|лимит запросов|время ожидания)
(Учётная запись|Ваш аккаунт|Сертификат|Пароль) (заблокирована|заблокирован|недействителен|неверен|не распознан)
(У нас|Возникли|Произошли) (технические неполадки|технические проблемы|сбой сервера|ошибка сервера)
(服务器|网站|系统|账户|证书)(没有响应|正在维护|出现故障|已被停用|无效|发生错误|繁忙)。
(サーバー|システム|アカウント|証明書)(からの応答がありません|に障害が発生しています|は停止されています|が無効です|はメンテナンス中です)。
"""

SCRIPT_NOTICE = """
(We need|You need|This page needs|This site needs|The viewer needs|This reader requires|This content requires|The catalogue requires) (JavaScript|scripts|scripting|cookies|cookies and scripts|active scripting) (to display this content|to show this page|to work|to run|to start|in order to load|to display the text|to be enabled|to be switched on|to be active)
(This page|This site|This viewer|This reader|The application) works (best|only|properly only) with (JavaScript|scripts|scripting|cookies) (turned on|enabled|switched on|allowed|active)
Without (JavaScript|scripts|scripting|cookies) (this|the|our) (catalogue|page|site|viewer|reader|content|application|book) (cannot be shown|can't be shown|cannot be displayed|will not work|won't load|does not work|cannot start|is unavailable)
(Looks like|It seems|It appears|We noticed) (JavaScript|scripting|your JavaScript) (is|has been) (switched off|turned off|disabled|off|blocked|not active|not enabled|inactive)
(Switch it on|Turn it on|Enable it|Activate it|Allow it) (to keep reading|to continue|and reload|and refresh the page|and try again|to proceed|to see the page)
(Your browser|This browser|The browser) (has scripting disabled|has JavaScript disabled|has JavaScript turned off|does not support JavaScript|does not run scripts|blocks scripts|is blocking JavaScript), so (this viewer can't start|the page cannot load|the text is not shown|we cannot show the page)
(To see|To read|To view|To open|To use) (the full text|this page|the content|this book|the catalogue|this site), (allow|enable|activate|turn on|switch on) (scripts|JavaScript|scripting|cookies) (for this domain|for this site|in your browser|in the settings)
(Sorry, this|This|The) (feature|page|viewer|content|function|section) is (unavailable|not available|hidden|blocked) because JavaScript is (not active|disabled|turned off|off|not enabled|not available)
(One moment|Just a moment|Please wait|Hold on), (we are|we're|while we are) (making sure|checking that|verifying that|checking) (your browser is secure|you are human|your browser|your connection is secure|the security of your browser)
(Please|Kindly) (activate|enable|turn on|switch on|allow) (scripting|JavaScript|scripts|cookies|Javascript) and (refresh|reload|reopen) (this window|this page|the page|your browser|the tab)
(Cookies and scripts|Scripts|Cookies|JavaScript and cookies|Scripts and cookies) (have to be|must be|need to be|should be) (enabled|allowed|switched on|activated) (for this reader|for this site|to continue|in your browser)
(Necesitamos|Se necesita|Necesita|Esta página necesita|Este visor requiere|Hace falta) JavaScript para (mostrar este contenido|ver esta página|continuar|funcionar|mostrar el catálogo|leer el texto)
Sin (JavaScript|scripts|cookies) (no se puede mostrar|no funciona|no se puede ver|no podemos mostrar|no es posible mostrar) (el catálogo|esta página|el contenido|este sitio|el visor)
(Parece que|Hemos detectado que) JavaScript está (apagado|desactivado|deshabilitado|bloqueado|inactivo). (Enciéndalo|Actívelo|Habilítelo) (para seguir leyendo|y recargue la página|para continuar)
(Un momento|Espere un momento|Por favor espere), estamos (verificando|comprobando) (la seguridad de su navegador|su navegador|que usted es humano|su conexión)
(Permita|Active|Habilite) (los scripts|JavaScript|las cookies|la ejecución de scripts) (para este sitio|en su navegador|en este dominio) y (actualice|recargue|vuelva a cargar) (la página|esta ventana)
(Nous avons besoin de|Il faut|Cette page a besoin de|Ce lecteur nécessite|Vous avez besoin de) JavaScript pour (afficher ce contenu|afficher cette page|continuer|lire le texte|fonctionner|voir le catalogue)
Sans (JavaScript|les scripts|cookies), (ce catalogue|cette page|ce contenu|ce site|ce lecteur) ne peut pas (être affiché|être affichée|fonctionner|s'ouvrir|être chargé)
(Un instant|Veuillez patienter|Patientez), nous vérifions (la sécurité de votre navigateur|votre navigateur|que vous êtes humain|votre connexion)
(Merci|Veuillez|Il convient) (d'autoriser|d'activer|autoriser|activer) (les scripts|JavaScript|les cookies|l'exécution des scripts) (pour ce site|dans votre navigateur|sur ce domaine) (puis d'actualiser la page|et recharger la page|puis recharger|et d'actualiser)
(Il semble que|On dirait que) JavaScript (soit|est) (désactivé|bloqué|inactif|coupé) (dans votre navigateur|sur ce poste)
(Wir brauchen|Wir benötigen|Sie benötigen|Diese Seite braucht|Dieser Leser benötigt) JavaScript, um (diesen Inhalt anzuzeigen|diese Seite anzuzeigen|fortzufahren|den Text zu zeigen|zu funktionieren|den Katalog zu öffnen)
Ohne (JavaScript|Skripte|Cookies) kann (dieser Katalog|diese Seite|dieser Inhalt|die Anwendung|das Buch) nicht (angezeigt werden|geladen werden|geöffnet werden|funktionieren|starten)
(Einen Moment|Bitte warten|Einen Augenblick), (die Sicherheit Ihres Browsers wird überprüft|Ihr Browser wird überprüft|wir prüfen Ihren Browser|Ihre Verbindung wird geprüft)
(Offenbar|Anscheinend|Es scheint, dass) ist JavaScript (ausgeschaltet|deaktiviert|abgeschaltet|blockiert|nicht aktiv). (Schalten Sie es ein|Aktivieren Sie es|Bitte einschalten), um (weiterzulesen|fortzufahren)
(Erlauben Sie|Aktivieren Sie|Bitte erlauben Sie) (Skripte|JavaScript|Cookies) (für diese Seite|in Ihrem Browser|für diese Domain) und (laden Sie die Seite neu|aktualisieren Sie die Seite)
(Precisamos de|É preciso|Esta página precisa de|Este leitor requer|Necessita de) JavaScript para (mostrar este conteúdo|ver esta página|continuar|funcionar|ler o texto|mostrar o catálogo)
Sem (JavaScript|scripts|cookies) não (é possível mostrar|podemos mostrar|funciona|se pode ver) (o catálogo|esta página|o conteúdo|este sítio)
(Parece que|Detetámos que) o JavaScript está (desligado|desativado|bloqueado|inativo). (Ligue-o|Ative-o) (para continuar a ler|e recarregue a página)
(Um momento|Aguarde), estamos a verificar (a segurança do seu navegador|o seu navegador|que é humano)
(Serve|Occorre|Abbiamo bisogno di|Questa pagina richiede|È necessario) JavaScript per (visualizzare questo contenuto|mostrare questa pagina|continuare|leggere il testo|funzionare)
Senza (JavaScript|script|cookie) (il catalogo|questa pagina|il contenuto|questo sito) non può essere (visualizzato|mostrato|caricato|aperta)
(Un momento|Attendere), stiamo verificando (la sicurezza del browser|il suo browser)
Для (просмотра этого содержимого|просмотра страницы|работы сайта|чтения текста|отображения каталога) (нужен|необходим|требуется|включите) JavaScript
(Без|Похоже,) JavaScript (страница не может быть показана|отключён|выключен|не работает). (Включите его|Разрешите скрипты) и (обновите страницу|продолжите)
(查看|显示|浏览)(此内容|本页|该页面|目录|全文)(需要启用|需要|必须启用|请启用) JavaScript。
(您的浏览器|浏览器)(未启用|禁用了|不支持|已关闭) JavaScript，(请启用后刷新|请打开后重试|无法显示页面)。
(この|当)(コンテンツ|ページ|サイト|本)を(表示する|閲覧する|読む|利用する)には JavaScript (が必要です|を有効にしてください|の有効化が必要です|をオンにしてください)。
(ブラウザー|ブラウザ)の(JavaScript|スクリプト)が(無効です|オフになっています|ブロックされています)。
(هذا|هذه) (المحتوى|الصفحة|الموقع|القارئ) (يتطلب|تتطلب|يحتاج إلى) (تشغيل|تفعيل|تمكين) JavaScript
(इस|यह) (सामग्री|पृष्ठ|साइट) को (देखने|खोलने|पढ़ने) के लिए JavaScript (चालू करें|सक्षम करें|आवश्यक है)
(โปรดเปิดใช้งาน|จำเป็นต้องเปิด|ต้องใช้) JavaScript (เพื่อแสดงเนื้อหานี้|เพื่อดูหน้านี้|เพื่ออ่านต่อ)
(Script execution|Scripting|JavaScript execution|Running scripts|JS) is (turned off|disabled|blocked|not permitted|switched off|prevented), (therefore|so|and so) (nothing can be rendered|the page stays empty|the page cannot load|nothing is shown|this view is empty)
(Enable|Allow|Turn on|Activate|Switch on) (JS|Javascript|JavaScript|scripting|active content) (to proceed|to continue|to go on|to read on|to browse|in order to browse the collection)
(An up-to-date|A modern|A current|A recent|A supported) browser with (JavaScript support|JavaScript enabled|scripting enabled|JavaScript) is (mandatory|required|needed|necessary)
(Ad blockers|Extensions|Disabled scripts|Browser extensions|Privacy settings|Script blockers) (or disabled scripts|or extensions|) may (stop|prevent|keep) (this viewer|this page|the reader|the site) from (loading|working|starting|opening)
Your (settings|browser settings|security settings|extensions|ad blocker) (prevent|prevents|block|stop) (scripts|JavaScript|cookies) from (running|loading|being set); (change them|adjust them|disable it) and (return|reload|try again)
If you (see|can read|are seeing) this (line|message|text|notice), (JavaScript|scripting|your browser) (did not load|is not running|is disabled|could not be started|failed to load|does not support scripts)
(noscript|No script|No JavaScript|JavaScript error|JavaScript missing): (turn scripting on|enable JavaScript|please turn it on|activate it) (to browse the collection|to use the site|to go on)
(Verifying|Checking|Testing|Inspecting) (your browser|the browser|your connection), this (takes|may take|will take) (a few seconds|a moment|up to five seconds)
(Debe|Hay que|Tiene que|Es necesario) (permitir|activar|habilitar|encender) (JS|JavaScript|los scripts|las cookies) para (navegar por la colección|usar el sitio|ver el catálogo|seguir)
Si (ve|lee|está viendo) (esta línea|este mensaje|este texto), JavaScript (no se ha cargado|está desactivado|no funciona|no está activo)
(L'exécution des scripts|L'exécution de JavaScript|Le JavaScript) est (coupée|désactivée|bloquée|désactivé|interdite) : (rien ne peut s'afficher|la page reste vide|le contenu est masqué)
Si vous (voyez|lisez) (cette ligne|ce message|ce texte), JavaScript (n'a pas été chargé|est désactivé|ne fonctionne pas|n'est pas actif)
Die Ausführung von (Skripten|JavaScript) ist (abgeschaltet|deaktiviert|blockiert|nicht erlaubt)
Wenn Sie (diese Zeile|diese Meldung|diesen Text) (sehen|lesen), (wurde JavaScript nicht geladen|ist JavaScript ausgeschaltet|funktioniert JavaScript nicht)
Se (vê|lê|está a ver) (esta linha|esta mensagem|este texto), o JavaScript (não foi carregado|está desativado|não funciona)
Se (vede|legge) (questa riga|questo messaggio), JavaScript (non è stato caricato|è disattivato|non funziona)
(Скрипты|Сценарии) (отключены|заблокированы|запрещены), (содержимое не отображается|страница не загружается|включите их)
(脚本|JavaScript)(已被阻止|被禁用|未加载|已关闭)，(页面无法显示|请启用|无法继续)。
(スクリプト|JavaScript)が(実行できない|無効な|読み込まれていない)ため(表示できません|ページを開けません)。
"""

INSTRUCTION = """
[(Your|The|Author|Company) (company name|author name|name|title|photo|biography|address|logo|summary|text|date) goes here]
[(Describe|Explain|Summarise|Introduce|Present|List|Mention|Outline) (the collection|the book|the chapter|your work|the author|the contents|the edition|the printer) in (two or three sentences|a few sentences|a few words|one paragraph|your own words)]
[(Fill in|Enter|Insert|Add|Type|Write|Give|Put|Supply) (the|your|an|a) (name of the printer|name of the author|date|title|place|summary|abstract|caption|image|photograph|reference|shelf mark|quotation|table|biography) here]
(Insert|Add|Type|Enter|Write|Paste|Put) (the|your|a|chapter|section|author|book|short) (summary|abstract|text|title|name|caption|quotation|figure|table|image|introduction|conclusion|biography|date) (here|in this place|below|at this point)
(TODO|TO DO|FIXME|TBD|XXX|Pending|TK): (finish|complete|write|check|add|expand|revise|rewrite|insert|verify|update) (this paragraph|this section|the introduction|the missing footnote|the bibliography|the references|the caption|the dates|this chapter|the table|the index)
(TBD|TBC|TBA|To be completed|To be written|To be decided|To be confirmed|To be supplied) by (the editor|the author|the museum|the publisher|the translator|the proofreader)
((caption|photo|figure|text|summary|date|title|table|map|index|list|credit|name) (to be supplied|to follow|to come|to be added|to be written|to be inserted|to be confirmed|missing|pending) (by the museum|by the author|by the editor|later|soon))
(Please|Remember to|Don't forget to|You must) (replace|delete|remove|complete|fill in|rewrite|update|check) (this|the following) (sentence|line|paragraph|section|text|note|placeholder|block) (before going to press|before printing|before publication|before you publish|later|with your own text)
(Double-click|Click|Click here|Tap|Click twice) to (edit|add|enter|change|insert|replace) (this heading|the heading|a title|text|a subtitle|your text|this text|an image|a caption|notes)
(Note to|Message to|Reminder for|Note for) (editor|the editor|author|the author|self|the typesetter|the translator|the proofreader): (add|check|complete|insert|find|write|verify) (the missing footnote|this part|the date|the figure|the source|the reference|a summary|the spelling)
[(Escriba|Describa|Indique|Introduzca|Ponga|Añada|Inserte|Complete|Resuma|Explique) (aquí|) (una breve descripción de la colección|el nombre del impresor|el nombre del autor|la fecha|el título|un resumen|su texto|la biografía|el pie de foto|el texto del capítulo)]
(PENDIENTE|POR HACER|FALTA|COMPLETAR|REVISAR): (añadir|redactar|completar|revisar|escribir|comprobar|insertar) (la bibliografía|la introducción|el resumen|las notas|esta sección|el capítulo|las fechas|el pie de foto|la tabla)
((pie de foto|texto|resumen|fecha|título|nota|lista|tabla|mapa|foto|nombre) (por definir|por completar|pendiente|por confirmar|por añadir|por determinar|a completar|pendiente de redactar))
(Sustituya|Borre|Elimine|Reemplace|Complete|Cambie) (esta frase|esta línea|este párrafo|este texto|esta nota|esta sección) (antes de imprimir|antes de publicar|por su texto|antes de la impresión)
[(Décrivez|Indiquez|Insérez|Saisissez|Ajoutez|Complétez|Écrivez|Présentez|Résumez|Précisez) (ici|) (la collection en quelques phrases|le nom de l'imprimeur|le nom de l'auteur|la date|le titre|un résumé|votre texte|la biographie|la légende|le texte du chapitre)]
(À COMPLÉTER|À FAIRE|À RÉDIGER|À VÉRIFIER|À REVOIR) : (ajouter|rédiger|compléter|vérifier|insérer|écrire) (la bibliographie|l'introduction|le résumé|les notes|cette section|le chapitre|les dates|la légende|le tableau)
((légende|texte|résumé|date|titre|note|liste|tableau|carte|photo|nom) (à fournir|à compléter|à venir|à définir|à confirmer|à ajouter|à rédiger|à déterminer))
(Remplacez|Supprimez|Effacez|Complétez|Modifiez) (cette phrase|cette ligne|ce paragraphe|ce texte|cette note) (avant impression|avant l'impression|avant publication|par votre texte)
[(Beschreiben Sie|Geben Sie|Fügen Sie|Schreiben Sie|Nennen Sie|Ergänzen Sie|Tragen Sie) hier (die Sammlung in wenigen Sätzen|den Namen des Druckers|den Namen des Verfassers|das Datum|den Titel|eine Zusammenfassung|Ihren Text|die Bildunterschrift) (ein|an|)]
[(Namen des Druckers|Namen des Verfassers|Datum|Titel|Ort|Bild|Zusammenfassung|Signatur|Quelle|Bildunterschrift) (eintragen|einfügen|ergänzen|einsetzen|angeben|nachtragen)]
(TODO|OFFEN|ZU ERLEDIGEN|FEHLT|NOCH OFFEN): (Literaturverzeichnis|Einleitung|Zusammenfassung|Abschnitt|Kapitel|Fußnote|Bildunterschrift|Tabelle|Datum) (ergänzen|schreiben|prüfen|einfügen|überarbeiten|nachtragen)
((Bildunterschrift|Text|Zusammenfassung|Datum|Titel|Tabelle|Karte|Liste|Abbildung) (wird nachgereicht|folgt|folgt noch|fehlt noch|noch offen|wird ergänzt|ist noch zu ergänzen))
(Ersetzen Sie|Löschen Sie|Ergänzen Sie|Überschreiben Sie) (diesen Satz|diese Zeile|diesen Absatz|diesen Text|diese Notiz) (vor dem Druck|vor der Veröffentlichung|durch Ihren Text)
[(Descreva|Indique|Insira|Escreva|Introduza|Acrescente|Complete|Resuma) (aqui|) (a coleção em poucas frases|o nome do impressor|o nome do autor|a data|o título|um resumo|o seu texto|a biografia|a legenda)]
(A COMPLETAR|A FAZER|PENDENTE|A REVER|FALTA): (acrescentar|escrever|completar|verificar|inserir|rever) (a bibliografia|a introdução|o resumo|as notas|esta secção|o capítulo|as datas|a legenda)
((legenda|texto|resumo|data|título|nota|lista|tabela|mapa) (por definir|por completar|a definir|a preencher|a confirmar|pendente|em falta))
(Substitua|Apague|Elimine|Remova|Complete) (esta frase|esta linha|este parágrafo|este texto|esta nota) (antes de imprimir|antes de publicar|antes da impressão|pelo seu texto)
[(Descrivere|Indicare|Inserire|Scrivere|Aggiungere|Completare|Riassumere) qui (la collezione in poche frasi|il nome dello stampatore|il nome dell'autore|la data|il titolo|un riassunto|il testo|la biografia|la didascalia)]
(DA COMPLETARE|DA FARE|DA SCRIVERE|DA VERIFICARE|MANCA): (aggiungere|scrivere|completare|verificare|inserire) (la bibliografia|l'introduzione|il riassunto|le note|questa sezione|il capitolo|le date|la didascalia)
(Sostituire|Cancellare|Eliminare|Completare) (questa frase|questa riga|questo paragrafo|questo testo) (prima della stampa|prima di pubblicare)
[(Вставьте|Укажите|Опишите|Добавьте|Впишите) (здесь|сюда) (название|имя автора|дату|краткое описание|подпись|текст|аннотацию)]
(СДЕЛАТЬ|ДОПОЛНИТЬ|ДОПИСАТЬ|ПРОВЕРИТЬ): (добавить|написать|проверить) (библиографию|введение|примечания|раздел|главу|даты)
【(在此|请在此)(插入|填写|输入|添加|描述)(作者姓名|书名|日期|摘要|简介|图片说明)】
（(摘要|图片说明|日期|作者|标题)(待补充|待定|待补|待确认|稍后补充)）
[(ここに)(著者名|書名|日付|要約|説明|図の説明)を(入力|記入|挿入|追加)(してください|する|)]
[(أدخل|اكتب|أضف|صف) هنا (اسم المؤلف|العنوان|التاريخ|الملخص|وصف المجموعة|النص)]
[(यहाँ) (लेखक का नाम|शीर्षक|तिथि|सारांश|विवरण) (लिखें|डालें|भरें|जोड़ें)]
[(Put|Place|Drop|Paste|Attach|Show) (a picture|a photo|an image|the logo|a map|a quotation|a table) (of the building|of the author|of the cover|of the press) (in this spot|here|in this box|at this point|above|below)]
[(Say|State|Tell|Note|Specify|Name) (who paid for the binding|who wrote this|where it was printed|when it was bound|how many copies|which edition|what the reader learns)]
(Somebody|Someone|Author|Editor|The author) (please write|please add|should write|must supply|please check|to write|to add) (the closing remarks|the introduction|the ending|a summary|this section|the caption|the last paragraph)
((to do|note|query|check|question): (ask|check with|confirm with|wait for) (the binder|the author|the museum|the editor|the printer) (for the date|about the name|for the picture|before printing))
(TK|TKTK|XX|NN|??|N.N.): (number of plates|number of pages|name of the binder|date of the edition|price|place|title|figure)
(Overwrite|Replace|Exchange|Substitute|Swap) (this text|this line|these words|this sample|the sample text) (with your own|by your own text|with the real one|with the final version)
(Your|My|Enter your|Type your|Add your) (headline|title|subtitle|name|text|tagline|caption|company|story|quote) (here|goes here|)
[(Añada|Ponga|Coloque|Pegue|Adjunte) (una foto|una imagen|un mapa|el logotipo|una cita) (del edificio|del autor|de la portada|aquí)]
(Escriba|Ponga|Añada|Introduzca) su (titular|título|nombre|texto|subtítulo|lema) (aquí|)
((dato|texto|fecha|nombre|imagen) que debe (facilitar|completar|aportar|indicar) (el museo|el autor|la editorial|la imprenta))
[(Mettez|Placez|Collez|Insérez|Joignez) (une photo|une image|une carte|le logo|une citation) (du bâtiment|de l'auteur|de la couverture|ici)]
((à préciser|à compléter|à fournir|à indiquer|à vérifier) par (le musée|l'auteur|l'éditeur|l'imprimeur))
(Votre|Saisissez votre|Ajoutez votre) (titre|nom|texte|légende|slogan) (ici|)
[(Foto|Bild|Karte|Logo|Zitat) (des Gebäudes|des Verfassers|des Einbands|hier) (einsetzen|einfügen|platzieren|ergänzen)]
(Überschrift|Titel|Name|Text|Untertitel|Bildunterschrift) (eingeben|eintragen|hier eingeben|hinzufügen)
((vom Museum|vom Verfasser|vom Verlag|vom Drucker|von der Redaktion) (zu ergänzen|zu liefern|einzutragen|nachzureichen|zu prüfen))
[(Colocar|Pôr|Juntar|Colar) (uma fotografia|uma imagem|um mapa|o logótipo) (do edifício|do autor|da capa|aqui)]
((a indicar|a completar|a fornecer|a confirmar) (pelo museu|pelo autor|pelo editor|pela editora))
"""

_GROUP = re.compile(r"\(([^()|]*(?:\|[^()|]*)+)\)")


def expand(patterns: str) -> list[str]:
    """Every combination of each pattern, in the order in which they stand."""
    out = []
    for line in patterns.strip().split("\n"):
        parts = _GROUP.split(line)
        options = [[p] if i % 2 == 0 else p.split("|") for i, p in enumerate(parts)]
        out += [re.sub(r" +", " ", "".join(c)) for c in product(*options)]
    return out


def grams(patterns: str) -> list[str]:
    """Examples in which each pair of neighbouring parts of each pattern occurs: all joints, without all combinations."""
    out = []
    for line in patterns.strip().split("\n"):
        parts = _GROUP.split(line)
        options = [[p] if i % 2 == 0 else p.split("|") for i, p in enumerate(parts)]
        size = max(len(o) for o in options)
        choices = [o for o in options if len(o) > 1]
        if not choices:
            out.append(line)
            continue
        seen = set()
        for shift in range(max(len(o) for o in choices)):
            for k in range(size):
                pick, j = [], 0
                for o in options:
                    pick.append(o[(k + j * shift) % len(o)])
                    j += len(o) > 1
                text = re.sub(r" +", " ", "".join(pick))
                if text not in seen:
                    seen.add(text)
                    out.append(text)
    return out
