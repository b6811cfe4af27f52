"""Example texts by which the residue models are fitted (fixed values).

They were written with the test tables in view: many wordings occur there, others are of the same kinds. How well the
models find wordings that are not among them is measured in the README.
"""

FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur lorem ipsum
qwerty qwerty asdf asdf jkl; jkl; zzz zzz xxxx xxxx abc abc foo foo bar bar baz blah blah test test aaa bbb
asdf jkl; asdf qwerty foo blah abc test zzz xxxx foo abc qwerty asdf test blah jkl; zzz abc xxxx
xxxx zzz blah foo test abc xxxx jkl; qwerty blah zzz asdf abc foo test jkl; blah
text text text text, text text text. text goes here text goes here. body copy body copy. dummy text dummy text
body copy body copy body copy. sample text sample text sample text, sample text. word word word word
texto texto texto texto, texto texto texto. texte texte texte texte, texte texte. Text Text Text Text, Text Text Text.
testo testo testo testo, testo testo testo. palabra palabra palabra. mot mot mot. wort wort wort. palavra palavra palavra.
Your text goes here. Your text goes here, Your text goes here - Your text goes here
Placeholder paragraph, replace me. Placeholder paragraph, replace me, Placeholder paragraph, replace me - replace me
This is dummy text. This is placeholder text. Filler paragraph, to be replaced. Sample paragraph, replace me.
Aquí va el texto. Aquí va el texto, Aquí va el texto - Su texto va aquí. Texto de relleno. Texto de ejemplo.
Párrafo de relleno, sustituir. Párrafo de relleno, sustituir, Párrafo de relleno, sustituir - Este es un texto de relleno.
O seu texto vai aqui. O seu texto vai aqui, O seu texto vai aqui - Aqui vai o texto. Texto de enchimento.
Parágrafo de enchimento, substituir. Parágrafo de enchimento, substituir, Parágrafo de enchimento, substituir -
Votre texte ici. Votre texte ici, Votre texte ici - Ceci est un faux texte. Ceci est un faux texte, Ceci est un faux texte -
Paragraphe factice à remplacer. Paragraphe factice à remplacer, Paragraphe factice à remplacer - texte de remplissage
Dies ist ein Blindtext. Dies ist ein Blindtext, Dies ist ein Blindtext - Hier steht später der Text. Hier steht später der Text,
Fülltext, bitte ersetzen. Fülltext, bitte ersetzen, Fülltext, bitte ersetzen - Platzhaltertext. Blindtext Blindtext.
Dummy text. Filler text. Sample text here. Insert text here, insert text here, insert text here. This is only filler text. Some text, some text, some text. Replace this dummy text.
Texto de muestra. Texto de prueba. Este es un texto de prueba. Texto ficticio. Su texto aquí. Este es un texto de ejemplo. Este é um texto de exemplo. Texto fictício. Texto de teste. Ceci est un texte d'exemple. Texte fictif. Texte de test. Das ist ein Platzhaltertext. Mustertext. Beispieltext. Hier kommt Text hin.
Questo è un testo di prova. Testo di esempio. Testo fittizio. Paragrafo di prova. bla bla bla. lorem lorem lorem. hjkl hjkl fdsa fdsa uiop uiop. abc def ghi abc def ghi. aaaa bbbb cccc dddd.
Il tuo testo va qui. Il tuo testo va qui, Questo è un testo segnaposto. Paragrafo di riempimento, sostituire.
Здесь будет текст. Здесь будет текст, Это текст-заполнитель. Рыба текст.
此处填写文字。此处填写文字。这是占位文字。示例文字示例文字。
ここに文章が入ります。ここに文章が入ります。ダミーテキストです。サンプルテキスト。
यहाँ पाठ आएगा। यहाँ पाठ आएगा। نص تجريبي. هنا يوضع النص. هنا يوضع النص. ข้อความตัวอย่าง ข้อความอยู่ที่นี่
"""

ERROR_PAGE = """
404 Not Found. 404 page not found. Error 404: page not found. Error 404 - The page you requested could not be found.
500 Internal Server Error. Error 500: internal server error. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout. 403 Forbidden.
HTTP status 404. HTTP status 500. HTTP status 502. HTTP status 503. HTTP status 504. HTTP status 403. HTTP error 429.
Service temporarily unavailable. Please try again later. Too many requests (429). Slow down. Oops! Something went wrong.
Access denied. You do not have permission to view this file. You are not authorised to access this page.
Your session has expired. Please log in again. The server could not be reached. Connection to the server failed. Connection timed out.
This document has been moved or deleted. The requested document no longer exists. The page you are looking for does not exist or has moved.
Conversion failed: the remote host closed the connection. An unexpected error occurred. The request could not be completed.
Request id: 9f3a51bc. Trace: 9f3a51bc -> 9f3a51bc. at reader.load (line 51203). gateway / 2.114
Error 404: página no encontrada. 404 - Página no encontrada. La página solicitada no existe o ha cambiado de dirección.
Error 500: error interno del servidor. Acceso denegado. No tiene permiso para ver este archivo. ¡Vaya! Algo salió mal.
Su sesión ha caducado. Vuelva a iniciar sesión. Servicio no disponible temporalmente. Inténtelo más tarde.
No se pudo establecer conexión con el servidor. Demasiadas solicitudes. El documento se ha movido o eliminado. La conversión ha fallado.
Erro 404: página não encontrada. A página solicitada não existe ou mudou de endereço. Erro interno do servidor (500).
Acesso negado. Não tem permissão para ver este ficheiro. A sua sessão expirou. Inicie sessão novamente. Volte a entrar.
Serviço temporariamente indisponível. Tente novamente mais tarde. Ups! Algo correu mal. Não foi possível ligar ao servidor.
Erreur 404 : page introuvable. La page demandée n'existe pas ou a été déplacée. Erreur interne du serveur (500).
Accès refusé. Vous n'avez pas l'autorisation de consulter ce fichier. Votre session a expiré. Reconnectez-vous. Veuillez vous reconnecter.
Service momentanément indisponible. Réessayez plus tard. Une erreur est survenue. Impossible de joindre le serveur.
Fehler 404 – Seite nicht gefunden. Die angeforderte Seite existiert nicht mehr. Interner Serverfehler (500).
Zugriff verweigert. Sie haben keine Berechtigung für diese Datei. Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Dienst vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut. Hoppla! Etwas ist schiefgelaufen. Keine Verbindung zum Server.
400 Bad Request. 401 Unauthorized. 408 Request Timeout. 410 Gone. The server returned an error. The server is not responding. The connection was refused. The connection was reset.
The site is down for maintenance. This page is currently unavailable. We could not find that page. We can't find the page you are looking for. That page does not exist. The link may be broken or the page may have been removed.
You are not allowed to open this document. You need permission to access this item. Authentication required. Please sign in to continue. Sign in again. Your login has timed out. Please refresh the page and try again. Try again in a few minutes.
Sorry, an error has occurred. An unknown error has occurred. Something went wrong. Error while loading the file. The upload failed. The download failed. Export failed: file not found. Could not open the document. Rate limit exceeded.
El servidor no responde. Se ha producido un error. Error al cargar el archivo. No se ha encontrado la página. El enlace puede estar roto. La página que busca ya no está disponible. No está autorizado para ver esta página. No tiene permiso para acceder a este documento. Inicie sesión para continuar. Se agotó el tiempo de espera. La exportación ha fallado. Sitio en mantenimiento.
O servidor não responde. Ocorreu um erro. Erro ao carregar o ficheiro. A página que procura já não está disponível. Não tem autorização para aceder a este documento. Inicie sessão para continuar. O tempo de espera esgotou-se. A conversão falhou. A ligação foi recusada. Sítio em manutenção. Tente de novo.
Le serveur ne répond pas. Une erreur s'est produite. Erreur lors du chargement du fichier. La page que vous cherchez n'est plus disponible. Le lien est peut-être rompu. Vous n'êtes pas autorisé à ouvrir ce document. Connectez-vous pour continuer. Délai d'attente dépassé. La conversion a échoué. Ce document a été supprimé. Site en maintenance. Trop de requêtes.
Der Server antwortet nicht. Es ist ein Fehler aufgetreten. Fehler beim Laden der Datei. Die gesuchte Seite ist nicht mehr verfügbar. Der Link ist möglicherweise defekt. Sie sind nicht berechtigt, dieses Dokument zu öffnen. Melden Sie sich an, um fortzufahren. Zeitüberschreitung der Anfrage. Die Konvertierung ist fehlgeschlagen. Dieses Dokument wurde gelöscht. Wartungsarbeiten. Zu viele Anfragen.
Il server non risponde. Si è verificato un errore. La pagina cercata non è più disponibile. Non si dispone dell'autorizzazione per aprire il documento. Accedere di nuovo. La conversione non è riuscita. Riprovare più tardi.
Errore 404: pagina non trovata. La pagina richiesta non esiste o è stata spostata. Errore interno del server (500). Accesso negato. La sessione è scaduta.
Ошибка 404: страница не найдена. Внутренняя ошибка сервера. Доступ запрещён. Сервис временно недоступен. Сеанс истёк.
错误 404：找不到页面。服务器内部错误。拒绝访问。服务暂时不可用，请稍后再试。会话已过期。
エラー404：ページが見つかりません。サーバー内部エラー。アクセスが拒否されました。しばらくしてからもう一度お試しください。
त्रुटि 404: पृष्ठ नहीं मिला। خطأ 404: الصفحة غير موجودة. ข้อผิดพลาด 404: ไม่พบหน้านี้
"""

SCRIPT_NOTICE = """
Please enable JavaScript to continue. You need to enable JavaScript to run this app. JavaScript is disabled in your browser. Turn it on and reload.
Please enable JavaScript to view this page. This site requires JavaScript. JavaScript must be enabled to use this site.
Java Script required - your browser does not support it or it is turned off. Your browser does not support JavaScript.
Checking your browser before opening the book. Scripts must be allowed. This reader needs scripts and cookies to be switched on.
Checking your browser before accessing the site. Please allow scripts and cookies. Please turn JavaScript on and reload the page.
Active JavaScript para continuar. Debe habilitar JavaScript para ver esta página. JavaScript está desactivado en su navegador. Habilítelo y recargue.
Comprobando su navegador. Permita la ejecución de scripts. Este lector necesita que los scripts y las cookies estén permitidos.
Se requiere JavaScript: su navegador no lo admite o está desactivado. Es necesario activar JavaScript para usar esta aplicación.
Ative o JavaScript para continuar. É necessário ativar o JavaScript para ver esta página. O JavaScript está desativado no seu navegador. Ative-o e recarregue.
A verificar o seu navegador; os scripts têm de ser permitidos. Este leitor precisa de scripts e cookies permitidos.
Veuillez activer JavaScript pour continuer. Vous devez activer JavaScript pour afficher cette page. JavaScript est désactivé dans votre navigateur. Activez-le et rechargez.
Vérification de votre navigateur ; les scripts doivent être permis. Ce lecteur exige que les scripts et les cookies soient autorisés.
Bitte aktivieren Sie JavaScript, um fortzufahren. JavaScript ist in Ihrem Browser ausgeschaltet. Schalten Sie es ein und laden Sie neu. Sie müssen JavaScript aktivieren.
Ihr Browser wird geprüft; Skripte müssen erlaubt sein. Dieser Leser benötigt Skripte und Cookies. Diese Seite benötigt JavaScript.
JavaScript is required to use this application. JavaScript is not enabled. This application needs JavaScript and cookies. Enable scripts in the settings of your browser and reload this page. Your browser is blocking scripts. Scripts are blocked. Turn on cookies and scripts. Please turn on JavaScript in your browser and refresh. We are checking your browser. Verifying that you are human. Allow scripts to run.
Esta aplicación necesita JavaScript. Habilite JavaScript en su navegador y recargue la página. Su navegador bloquea los scripts. Active los scripts y las cookies. Estamos comprobando su navegador. JavaScript no está habilitado. Actívelo y vuelva a cargar.
Esta aplicação precisa de JavaScript. Ative os scripts no seu navegador e recarregue a página. O seu navegador bloqueia os scripts. JavaScript não está ativado. Permita a execução de scripts.
Cette application nécessite JavaScript. Activez les scripts dans votre navigateur et rechargez la page. Votre navigateur bloque les scripts. JavaScript n'est pas activé. Autorisez l'exécution des scripts.
Diese Anwendung benötigt JavaScript. Aktivieren Sie Skripte in Ihrem Browser und laden Sie die Seite neu. Ihr Browser blockiert Skripte. JavaScript ist nicht aktiviert. Erlauben Sie die Ausführung von Skripten. Wir prüfen Ihren Browser.
Questa applicazione richiede JavaScript. Abilitare gli script nel browser e ricaricare la pagina.
Attiva JavaScript per continuare. JavaScript è disattivato nel browser. Verifica del browser; gli script devono essere consentiti.
Включите JavaScript, чтобы продолжить. JavaScript отключён в вашем браузере. Проверка браузера.
请启用 JavaScript 以继续。您的浏览器已禁用 JavaScript。続行するには JavaScript を有効にしてください。ブラウザーを確認しています。
जारी रखने के लिए JavaScript सक्षम करें। يرجى تفعيل JavaScript للمتابعة. โปรดเปิดใช้งาน JavaScript เพื่อดำเนินการต่อ
"""

INSTRUCTION = """
[Insert a short biography of the author here] [Insert title here] [Add a summary here] [Insert author biography]
(summary to be supplied) (to be completed) (text to follow) (date to be confirmed) (abstract to be added)
Type the abstract here. Delete this line before publishing. Click to add subtitle. Click to add title. Click here to enter text.
TODO: write the introduction. TODO: add references. Chapter text TBD. Title TBD. FIXME: missing section. Author's note: complete this part.
[Insert date here] [Insert image here] [Add author name here] [Add text here] [Write the introduction here] [Your abstract here] [Replace this text] [To be completed by the editor]
(to be written) (to be filled in) (to be decided) (references to be added) (introduction to follow) (to be supplied by the author) (date to be supplied)
Write your text here. Enter the title here. Type your name here. Enter text here. Add a caption here. Remove this line before publication. Delete this paragraph before printing. Replace this paragraph. Click to add text. Click to edit. Fill in the date. Insert the table here.
TODO: check the dates. TODO: complete this section. TBD: title of the chapter. TBC. FIXME: add the missing table. Note to the author: complete this part. Editor: please add a summary. Section text TBD. Summary TBD.
[Insertar fecha] [Insertar aquí el resumen] [Añadir texto aquí] [Escriba aquí su nombre] (por completar) (pendiente de redactar) (introducción pendiente) Escriba aquí su texto. Introduzca el título aquí. Elimine esta línea antes de imprimir. Haga clic para agregar un título. PENDIENTE: completar esta sección. POR HACER: revisar las fechas.
[Inserir data] [Inserir aqui o resumo] [Acrescentar texto aqui] (por completar) (a preencher) Escreva aqui o texto. Introduza aqui o título. Elimine esta linha antes de imprimir. Clique para adicionar um título. Clique para adicionar texto. A FAZER: completar esta secção.
[Insérer la date] [Insérer ici le résumé] [Ajouter le texte ici] (à compléter) (à rédiger) (introduction à venir) Saisissez votre texte ici. Entrez le titre ici. Supprimez cette ligne avant l'impression. Cliquez pour ajouter un titre. Cliquez pour ajouter du texte. À FAIRE : compléter cette section. Texte de la section à définir.
[Hier Datum einfügen] [Hier Zusammenfassung einfügen] [Text hier ergänzen] (folgt noch) (noch zu ergänzen) (Einleitung folgt) Geben Sie hier Ihren Namen ein. Geben Sie hier den Titel ein. Löschen Sie diese Zeile vor dem Druck. Titel durch Klicken hinzufügen. Text durch Klicken hinzufügen. TODO: Abschnitt ergänzen. OFFEN: Kapitel schreiben.
[Insertar aquí la biografía del autor] [Inserte aquí el título] (resumen por completar) (texto pendiente)
Escriba aquí el resumen. Borre esta línea antes de publicar. Haga clic para agregar un subtítulo. Haga clic para agregar texto.
PENDIENTE: redactar la introducción. POR HACER: completar el capítulo. Texto del capítulo pendiente. Por determinar.
[Inserir aqui a biografia do autor] (resumo por preencher) (texto por completar)
Escreva aqui o resumo. Apague esta linha antes de publicar. Clique para adicionar um subtítulo. A FAZER: escrever a introdução. Texto do capítulo por definir.
[Insérer ici la biographie de l'auteur] (résumé à compléter) (texte à venir)
Saisissez le résumé ici. Supprimez cette ligne avant publication. Cliquez pour ajouter un sous-titre. À FAIRE : rédiger l'introduction. Texte du chapitre à définir.
[Hier Kurzbiografie einfügen] [Hier Titel einfügen] (Zusammenfassung folgt noch) (Text folgt)
Geben Sie hier den Text ein. Löschen Sie diese Zeile vor der Veröffentlichung. Untertitel durch Klicken hinzufügen. TODO: Einleitung schreiben. Kapiteltext noch offen. Geben Sie hier die Zusammenfassung ein.
[Inserire qui la biografia dell'autore] (riassunto da completare) Fare clic per aggiungere un sottotitolo. DA FARE: scrivere l'introduzione.
[Вставьте биографию автора] (аннотация будет добавлена) СДЕЛАТЬ: написать введение. 【在此插入作者简介】（摘要待补充）待办：撰写引言。 [ここに著者の略歴を挿入]（要約は後日追加）
"""

#: Page furniture, which stands beside residue and beside content and is neither.
FURNITURE = """
Home | Catalogue | Help. Back to the home page. Contact support. Contact us. Sign in. Search.
Inicio | Catálogo | Ayuda. Volver al inicio. Contactar. Iniciar sesión. Buscar.
Início | Catálogo | Ajuda. Voltar ao início. Contactar. Entrar. Pesquisar.
Accueil | Catalogue | Aide. Retour à l'accueil. Nous contacter. Contact. Se connecter. Rechercher.
Start | Katalog | Hilfe. Zurück zur Startseite. Kontakt. Anmelden. Suchen.
"""

#: Prose about residue, which is not residue.
ABOUT = """
The manual says that a reader should enable JavaScript only on trusted machines. Chapter 9 teaches JavaScript to librarians who have never written a script.
The author explains why printers set lorem ipsum in their specimens. The old site answered 404 for the missing plates, and the clerk wrote a report about it.
An internal server error delayed the reading by 12 minutes in the spring. The form letter used square brackets such as [name] as an example of a slot, and the handbook explains each one.
The note [sic] is the copyist's, and the gap [...] is ours. In his talk the printer showed how a page not found message is written.
El manual aconseja activar JavaScript solo en equipos de confianza. El capítulo 9 enseña JavaScript a bibliotecarios que nunca programaron.
El autor explica por qué los impresores usaban lorem ipsum en sus muestras. El sitio antiguo respondía 404 para las láminas perdidas, y la secretaria escribió un informe.
La carta modelo usaba corchetes como [nombre] a modo de ejemplo, y el manual explica cada uno. La nota [sic] es del copista, y la laguna [...] es nuestra.
Le chapitre 9 enseigne JavaScript aux bibliothécaires. L'auteur explique pourquoi les imprimeurs composaient lorem ipsum dans leurs modèles. L'ancien site répondait 404 pour les planches perdues, et la secrétaire en fit un rapport.
Kapitel 9 lehrt Bibliothekare JavaScript. Der Verfasser erklärt, warum Drucker Lorem ipsum in ihre Muster setzten. Die alte Seite meldete 404 für die fehlenden Tafeln, und die Schreiberin verfasste einen Bericht.
O capítulo 9 ensina JavaScript a bibliotecários. O autor explica por que os impressores usavam lorem ipsum. O site antigo respondia 404. Il capitolo 9 insegna JavaScript ai bibliotecari.
"""

#: Names of slots, as templates write them.
SLOT_NAMES = """
name your name author author name title book title chapter title page count pages number date print date publisher shelf mark place city address email
nombre su nombre nombre del autor autor titulo titulo libro capitulo titulo num paginas fecha editorial signatura lugar
nome seu nome nome do autor titulo livro num paginas data editora cota capitulo titulo
nom votre nom auteur titre titre livre chapitre titre nb pages date maison cote lieu
ihr name name des autors buchtitel kapitel titel seitenzahl datum verlag signatur ort
nome il tuo nome autore titolo libro capitolo titolo editore segnatura first name last name company phone subject user id
"""
