"""Wordings by which recall is measured (fixed values), by the same author as the library's lists.

The first lists were written before the patterns and slots, and these with them in mind: they show that what was meant is
covered. FRESH was written afterwards, in other words on purpose; after its first trial the patterns and slots were
extended, which now cover it. LAST was written after that, in ordinary words; after its first trial slots of refusals
were added once more, but no pattern of residue. The README gives the figures of the first trials.
"""

REFUSALS = """
I'm not in a position to provide that translation.
Apologies, but answering this is something I'm not allowed to do.
I'm afraid I have to decline.
We are not able to fulfil your request at this time.
This is not something I can do for you.
I don't feel comfortable responding to this prompt.
Unfortunately, I'm prevented from working on this kind of material.
My policies do not permit me to rewrite this paragraph.
I must respectfully refuse to continue with this.
It is not possible for me to carry out this task.
No estoy autorizado a realizar esa tarea.
Lamento decirle que no tengo permitido contestar a esto.
Me temo que debo rechazar la petición.
Perdone, pero esta pregunta no la puedo responder.
No está en mis manos hacer esa traducción.
Mis reglas me impiden trabajar con este texto.
No me es posible ofrecerle una respuesta.
Siento no poder ayudarle con este fragmento.
Declino contestar.
Por motivos de seguridad no puedo seguir con esta conversación.
Je regrette, mais je n'ai pas le droit de traduire ce passage.
Il m'est impossible de répondre à cette question.
Je ne suis pas autorisé à effectuer cette tâche.
Navré, je dois refuser cette demande.
Mes consignes m'interdisent de traiter ce contenu.
Je ne peux malheureusement pas donner suite à votre requête.
Ce n'est pas une chose que je peux faire.
Je décline poliment cette invitation à répondre.
Cette demande ne peut être satisfaite.
Pardon, mais je ne saurais vous aider là-dessus.
Das darf ich leider nicht übersetzen.
Diese Frage kann ich Ihnen nicht beantworten.
Ich bin nicht befugt, diesen Text zu bearbeiten.
Bedauerlicherweise muss ich diese Bitte ablehnen.
Dazu möchte ich mich nicht äußern.
Meine Vorgaben erlauben es mir nicht, darauf einzugehen.
Entschuldigen Sie, aber damit kann ich nicht dienen.
Ich sehe mich außerstande, diese Aufgabe zu erledigen.
Ich lehne es ab, darauf zu antworten.
Hierbei kann ich Sie nicht unterstützen.
Infelizmente não estou autorizado a responder.
Não me é permitido traduzir este texto.
Peço desculpa, mas tenho de recusar.
Esta tarefa não pode ser realizada por mim.
As minhas regras não permitem tratar este conteúdo.
Sinto muito, não poderei ajudar com esta pergunta.
Não tenho como atender à sua solicitação.
Recuso-me a continuar.
Não estou em condições de corrigir este parágrafo.
Lamentavelmente, isso está fora do que posso fazer.
Non mi è consentito tradurre questo testo.
Sono spiacente, devo rifiutare la richiesta.
Temo di non poter rispondere a questa domanda.
Le mie regole non mi permettono di trattare questo contenuto.
Non posso proseguire con questo compito.
Purtroppo non mi è possibile fornire una risposta.
Questa richiesta non può essere soddisfatta.
Mi scuso, ma non sono autorizzato a farlo.
Declino la richiesta.
Non me la sento di rispondere a questo.
Мне нельзя отвечать на этот вопрос.
Простите, но я вынужден отказаться.
Я не имею права переводить этот текст.
Увы, с этой задачей я помочь не смогу.
Мои правила не позволяют обрабатывать такое содержание.
Я не готов отвечать на это.
Данный запрос не может быть выполнен.
Сожалею, но это вне моих возможностей.
Я отказываюсь продолжать.
Как искусственный интеллект, я не вправе это комментировать.
很遗憾，我不能翻译这段内容。
这个问题我无法回答。
我没有权限处理您的请求。
根据规定，我不可以提供这样的回答。
不好意思，我必须拒绝。
此内容违反了我的使用准则，恕我不能继续。
恕难从命。
我不便对此作出回应。
作为人工智能，我不被允许完成这项任务。
请原谅，我帮不了您这个忙。
回答を差し控えさせていただきます。
この内容には対応いたしかねます。
恐れ入りますが、翻訳は行えません。
私にはこの質問に答えることが許可されていません。
ごめんなさい、それはできません。
ガイドラインに反するため、お受けできません。
残念ながらこの文章の修正はお断りします。
AIとして、そのような依頼には応じられません。
この件についてはお答えしかねます。
ご要望に沿うことができず申し訳ありません。
मैं इस प्रश्न का उत्तर नहीं दे सकता।
माफ़ कीजिए, मुझे इसकी अनुमति नहीं है।
मैं यह अनुवाद करने में असमर्थ हूँ।
खेद है कि यह कार्य मुझसे नहीं हो पाएगा।
यह अनुरोध मेरे नियमों के विरुद्ध है।
मुझे मना करना होगा।
एक भाषा मॉडल के रूप में मैं इस पाठ पर काम नहीं कर सकती।
मैं इस विषय पर जवाब देना नहीं चाहता।
दुर्भाग्यवश मैं आपकी मदद नहीं कर पाऊँगा।
इस सामग्री को संसाधित करना संभव नहीं है।
آسف، لا أستطيع الإجابة عن هذا السؤال.
لا يسمح لي بترجمة هذا النص.
أعتذر، لكنني مضطر إلى الرفض.
ليس بإمكاني تنفيذ هذه المهمة.
هذا الطلب يخالف القواعد الخاصة بي.
للأسف لن أتمكن من مساعدتك.
أفضل عدم الرد على هذا.
أنا غير قادر على معالجة هذا المحتوى.
بصفتي مساعدا آليا لا يحق لي التعليق على ذلك.
يؤسفني أنني لا أقدر على إكمال ما طلبته.
ขอโทษ ฉันตอบคำถามนี้ไม่ได้
เสียใจด้วย ผมไม่ได้รับอนุญาตให้แปลข้อความนี้
ฉันต้องขอปฏิเสธคำขอนี้
น่าเสียดายที่ฉันไม่สามารถทำงานนี้ให้ได้
เนื้อหานี้ขัดต่อแนวทางของฉัน
ดิฉันไม่สะดวกที่จะตอบเรื่องนี้
ขออภัยค่ะ ไม่สามารถดำเนินการตามคำขอได้
ในฐานะปัญญาประดิษฐ์ ฉันไม่อาจแก้ไขข้อความดังกล่าว
ฉันขอไม่ตอบคำถามนี้
กฎของฉันไม่อนุญาตให้ช่วยในเรื่องนี้
""".strip().split("\n")

#: Sound answers with denials in them, which are no refusals.
ANSWERS = """
The printer could not finish the second volume before the winter.
I cannot lend this atlas, said the librarian, because the binding is loose.
She was not allowed to open the case without the archivist.
No copy of the index was ever found.
The council refused to pay for the paper.
The editor would rather not print the map in colour.
Sorry, no copies left.
He declined the post of director in 1874.
The manuscript is not in a good condition and cannot be photographed.
It was impossible to read the third line.
La bibliotecaria no pudo abrir la caja antes del lunes.
El impresor se negó a firmar el contrato.
No se permite sacar los libros de la sala.
Lo siento, el atlas ya está prestado.
Nadie encontró las pruebas de imprenta.
Le relieur n'a pas pu terminer l'ouvrage avant l'hiver.
Il est interdit de photographier les planches.
Je ne trouve plus mon exemplaire, dit l'archiviste.
L'éditeur refusa de vendre la carte.
Das Museum konnte den Katalog nicht kaufen.
Die Bibliothekarin lehnte das Angebot des Verlags ab.
Leider ist der zweite Band verloren gegangen.
Der Druck war ohne Papier nicht möglich.
O tipógrafo não conseguiu acabar o volume antes do inverno.
A diretora recusou o convite da universidade.
Il legatore non poté finire il volume prima dell'inverno.
Il direttore rifiutò di firmare la lettera.
Переплётчик не смог закончить том до зимы.
Директор отказался подписать договор.
К сожалению, второй том утерян.
图书管理员在星期一之前无法打开箱子。
印刷商拒绝签署合同。
製本師は冬までにその本を完成できませんでした。
館長は契約書に署名することを断りました。
पुस्तकालयाध्यक्ष सोमवार से पहले बक्सा नहीं खोल सका।
निदेशक ने अनुबंध पर हस्ताक्षर करने से मना कर दिया।
لم تستطع أمينة المكتبة فتح الصندوق قبل يوم الاثنين.
رفض المدير توقيع العقد.
บรรณารักษ์ไม่สามารถเปิดกล่องก่อนวันจันทร์
ผู้อำนวยการปฏิเสธที่จะลงนามในสัญญา
""".strip().split("\n")

FILLER = """
Lorem ipsum dolor sit amet, sed consectetur magna elit tempor labore.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Here comes the body text. Here comes the body text. Here comes the body text.
blah blah blah blah blah blah
asdfasdf qwerqwer zxcvzxcv asdf qwer zxcv
This paragraph is only a stand-in and will be exchanged for the final copy.
Test test test. Testing, testing, one two three.
xxx xxx xxx xxxxx xxx xxxx
Some placeholder copy so that the layout can be judged.
Aquí irá el texto definitivo. Aquí irá el texto definitivo.
Este párrafo es un simple relleno hasta que llegue el texto final.
prueba prueba prueba prueba
Ici viendra le texte définitif. Ici viendra le texte définitif.
Ce paragraphe n'est qu'un bouche-trou en attendant le vrai texte.
Hier steht nur ein Beispielabsatz, der später ersetzt wird.
Blindtext für das Layout. Noch mehr Blindtext für das Layout.
Este parágrafo é apenas um texto provisório para a paginação.
Aqui ficará o texto final. Aqui ficará o texto final.
Questo paragrafo è solo un riempitivo in attesa del testo definitivo.
Testo segnaposto per la prova di impaginazione.
Это просто заполняющий текст для макета страницы.
这里是示例段落，稍后替换为正式内容。
これは仮の文章です。後で本文に差し替えてください。
هذا النص هو مثال لنص يمكن أن يستبدل في نفس المساحة.
यह केवल नमूना पाठ है जिसे बाद में बदला जाएगा।
""".strip().split("\n")

ERROR_PAGES = """
Unable to establish a database connection.
HTTP 418: the request was rejected by the server.
We're sorry, but the page you tried to reach isn't here.
This link has expired. Ask the owner for a new one.
The operation timed out while waiting for a response from the host.
An internal exception was thrown while rendering this view.
You don't have sufficient privileges to open this resource.
Bad request: malformed header.
The website is temporarily unable to service your request due to maintenance downtime.
DNS lookup failed. The host name could not be resolved.
SSL handshake failed: the certificate is not valid.
Fatal error: uncaught exception in module loader.
No se puede acceder a este sitio web en este momento.
El recurso solicitado fue eliminado o ya no existe.
Error de conexión con la base de datos.
La operación ha superado el tiempo máximo de espera.
No dispone de privilegios suficientes para abrir este recurso.
Impossible d'établir une connexion à la base de données.
Le lien que vous avez suivi a expiré.
La ressource demandée est introuvable sur ce serveur.
Cette opération a pris trop de temps et a été interrompue.
Die Verbindung zur Datenbank konnte nicht hergestellt werden.
Dieser Link ist abgelaufen.
Die angeforderte Ressource wurde auf diesem Server nicht gefunden.
Für diese Aktion fehlen Ihnen die nötigen Rechte.
Não foi possível estabelecer a ligação à base de dados.
O recurso solicitado não foi encontrado neste servidor.
A operação excedeu o tempo limite.
Impossibile stabilire una connessione con il database.
La risorsa richiesta non è stata trovata su questo server.
Не удалось установить соединение с базой данных.
无法连接到数据库，请联系管理员。
データベースに接続できませんでした。
تعذر الاتصال بقاعدة البيانات.
डेटाबेस से कनेक्शन स्थापित नहीं हो सका।
""".strip().split("\n")

SCRIPT_NOTICES = """
We need JavaScript to display this content.
This page works best with JavaScript turned on.
Without JavaScript this catalogue cannot be shown.
Looks like JavaScript is switched off. Switch it on to keep reading.
Your browser has scripting disabled, so this viewer can't start.
To see the full text, allow scripts for this domain.
Sorry, this feature is unavailable because JavaScript is not active.
One moment, we are making sure your browser is secure.
Please activate scripting and refresh this window.
Cookies and scripts have to be enabled for this reader.
Necesitamos JavaScript para mostrar este contenido.
Sin JavaScript no se puede mostrar el catálogo.
Parece que JavaScript está apagado. Enciéndalo para seguir leyendo.
Un momento, estamos verificando la seguridad de su navegador.
Nous avons besoin de JavaScript pour afficher ce contenu.
Sans JavaScript, ce catalogue ne peut pas être affiché.
Un instant, nous vérifions la sécurité de votre navigateur.
Merci d'autoriser les scripts pour ce site puis d'actualiser la page.
Wir brauchen JavaScript, um diesen Inhalt anzuzeigen.
Ohne JavaScript kann dieser Katalog nicht angezeigt werden.
Einen Moment, die Sicherheit Ihres Browsers wird überprüft.
Precisamos de JavaScript para mostrar este conteúdo.
Sem JavaScript não é possível mostrar o catálogo.
Serve JavaScript per visualizzare questo contenuto.
Senza JavaScript il catalogo non può essere visualizzato.
Для просмотра этого содержимого нужен JavaScript.
查看此内容需要启用 JavaScript。
このコンテンツを表示するには JavaScript が必要です。
هذا المحتوى يتطلب تشغيل JavaScript.
इस सामग्री को देखने के लिए JavaScript चालू करें।
""".strip().split("\n")

INSTRUCTIONS = """
[Your company name goes here]
[Describe the collection in two or three sentences]
[Fill in the name of the printer]
Insert chapter summary here.
TODO: finish this paragraph.
TBD by the editor.
(caption to be supplied by the museum)
Please replace this sentence before going to press.
Double-click to edit this heading.
Note to editor: add the missing footnote.
[Escriba aquí una breve descripción de la colección]
[Indique el nombre del impresor]
PENDIENTE: añadir la bibliografía.
(pie de foto por definir)
Sustituya esta frase antes de imprimir.
[Décrivez ici la collection en quelques phrases]
[Indiquez le nom de l'imprimeur]
À COMPLÉTER : ajouter la bibliographie.
(légende à fournir)
[Beschreiben Sie hier die Sammlung in wenigen Sätzen]
[Namen des Druckers eintragen]
TODO: Literaturverzeichnis ergänzen.
(Bildunterschrift wird nachgereicht)
[Descreva aqui a coleção em poucas frases]
A COMPLETAR: acrescentar a bibliografia.
[Descrivere qui la collezione in poche frasi]
DA COMPLETARE: aggiungere la bibliografia.
""".strip().split("\n")

SLOTS = """
Dear {{ first_name }}, your copy is ready.
Printed on %DELIVERY_DATE% in the old town.
Copyright ${publisher_name}, all rights reserved.
Hello <customer name>, your card has expired.
Shelf mark: [CALL NUMBER]
The book [[book.subtitle]] was bound by @@binder_name@@.
Estimado/a {nombre_cliente}: su ejemplar le espera.
Impreso en __CIUDAD__ el <%= fecha_impresion %>.
Cher/Chère {{prenom}}, votre exemplaire est prêt.
Sehr geehrte/r #NACHNAME#, Ihr Band ist fertig.
Firmado: ____________ Fecha: __/__/____
Caro/a «nome_cliente», o seu exemplar está pronto.
""".strip().split("\n")

#: Sound text that looks like residue or talks about it.
SOUND = """
See [[Main Page]] for the list of volumes.
The scripts are kept under ${HOME} on the reading machine.
The variable my___name holds the owner's signature.
The first leaf is the <Title Page> of the second state.
The note [sic] is the copyist's own.
The charter was signed on 3 May [1588] in the great hall.
Figure [A] shows the printer's device, {see the plate}.
In set notation the collection is {a, b, c}.
The printer enabled the young author to finish the second volume.
The server brought the guests wine and bread in the old reading room.
The page was not found among the leaves that the binder had kept.
Access to the tower was denied to visitors during the siege.
The connection between the two libraries was closed in 1874.
The session of the council expired at midnight without a vote.
A script of the fifteenth century fills the margins of the roll.
The browser of old catalogues needs patience and good light.
JavaScript was created in 1995, says the third chapter of the manual.
The librarian explained what a 404 error means and wrote it on the board.
The designer's specimen shows lorem ipsum because Latin words look neutral.
The council found no errors in the accounts and closed the meeting.
El archivo no está disponible los lunes porque la sala se limpia.
La conexión entre los dos museos se perdió después de la guerra.
La página no se encontró entre las hojas que guardó el encuadernador.
La page manquait dans l'exemplaire que le relieur avait gardé.
Le serviteur ferma la porte et l'accès fut refusé aux visiteurs.
Die Seite fehlte in dem Exemplar, das der Buchbinder aufbewahrte.
Der Zugang zum Turm wurde den Besuchern während der Belagerung verweigert.
A página faltava no exemplar que o encadernador guardou.
La pagina mancava nella copia che il legatore aveva conservato.
Страница отсутствовала в экземпляре, который хранил переплётчик.
""".strip().split("\n")

FRESH_REFUSALS = """
Handling that is off the table for me.
I'll have to pass on this one.
That's a no from me, sorry.
Producing such a rendering would break the rules I follow.
Regrettably, no answer can be given to this.
I'm going to sit this one out.
You'll need to find someone else for this job; I am not permitted to do it.
It's against my policy to respond.
Va a ser que no: este encargo queda fuera de mi alcance.
Siento comunicarle que no me dejan traducir esto.
No procede que responda a su consulta.
Tendrá que disculparme, pero no voy a hacerlo.
Je crains de devoir vous opposer un refus.
On ne m'autorise pas à réécrire ce paragraphe.
Ma réponse est non, je ne le ferai pas.
Cela sort du cadre de ce que je peux accomplir.
Da muss ich passen.
Eine Antwort darauf steht mir nicht zu.
Ich werde diesen Auftrag nicht ausführen.
Mir sind hier leider die Hände gebunden, ich darf das nicht bearbeiten.
Terei de declinar este convite.
Fico impedido de responder a isso.
Não vou traduzir este parágrafo, desculpe.
Mi vedo costretto a rifiutare.
Non intendo rispondere a questa domanda.
Questo compito esula dalle mie competenze.
Вынужден ответить отказом.
Этого я сделать не могу, простите.
Мне не позволено обсуждать эту тему.
我拒绝回答。
这超出了我的能力范围，请见谅。
抱歉，我不会翻译这篇文章。
お答えすることはできません。
その作業はお引き受けできません。
मैं यह काम नहीं करूँगा।
मुझे इस प्रश्न का उत्तर देने से मना किया गया है।
لن أجيب عن هذا السؤال.
لست مخولا بمعالجة هذا الطلب.
ฉันคงต้องขอปฏิเสธ
ไม่ขอตอบเรื่องนี้ค่ะ
""".strip().split("\n")

FRESH_FILLER = """
Nulla facilisi cras fermentum odio eu feugiat pretium nibh ipsum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium.
Copy to come. Copy to come. Copy to come.
Random words go in this box until the writer delivers.
dfg dfg hjk hjk lkj lkj
Nonsense text to fill up the column.
Stand-in wording, not for publication.
Texto simulado para llenar la columna.
palabras palabras palabras palabras
Faux paragraphe servant à remplir la colonne.
Nur Fülltext, damit die Spalte nicht leer bleibt.
Palavras de enchimento para ocupar a coluna.
Parole a caso per riempire la colonna.
Случайный текст для заполнения колонки.
占位用的文字，没有实际意义。
レイアウト確認用のダミー文です。
""".strip().split("\n")

FRESH_ERROR_PAGES = """
Whoa, that address leads nowhere.
We couldn't locate the record you asked for.
Your token is invalid or has been revoked.
Maximum number of retries exceeded.
Disk quota exceeded on the remote host.
The certificate presented by the peer is not trusted.
Segmentation fault (core dumped)
Backend returned status 503.
This account has been suspended.
Nothing matches the given URI.
The proxy did not receive a timely reply from the upstream server.
We are experiencing technical difficulties. Our engineers have been notified.
Esta cuenta ha sido suspendida.
Se ha superado el número máximo de intentos.
Estamos teniendo problemas técnicos; vuelva más tarde.
Nous rencontrons des difficultés techniques.
Le certificat présenté n'est pas valide.
Ce compte a été suspendu.
Wir haben derzeit technische Schwierigkeiten.
Die maximale Anzahl von Versuchen wurde überschritten.
Dieses Konto wurde gesperrt.
Estamos com dificuldades técnicas.
Stiamo riscontrando problemi tecnici.
Превышено время ожидания ответа.
服务器没有响应。
サーバーからの応答がありません。
""".strip().split("\n")

FRESH_SCRIPT_NOTICES = """
Script execution is turned off, therefore nothing can be rendered.
Enable JS to proceed.
An up-to-date browser with JavaScript support is mandatory.
Ad blockers or disabled scripts may stop this viewer from loading.
Your settings prevent scripts from running; change them and return.
If you see this line, JavaScript did not load.
noscript: turn scripting on in order to browse the collection.
Verifying your browser, this takes a few seconds.
Debe permitir JS para navegar por la colección.
Si ve esta línea, JavaScript no se ha cargado.
L'exécution des scripts est coupée : rien ne peut s'afficher.
Si vous voyez cette ligne, JavaScript n'a pas été chargé.
Die Ausführung von Skripten ist abgeschaltet.
Wenn Sie diese Zeile sehen, wurde JavaScript nicht geladen.
Se vê esta linha, o JavaScript não foi carregado.
Se vede questa riga, JavaScript non è stato caricato.
Скрипты отключены, содержимое не отображается.
脚本已被阻止，页面无法显示。
""".strip().split("\n")

FRESH_INSTRUCTIONS = """
[Put a picture of the building in this spot]
[Say who paid for the binding]
Somebody please write the closing remarks.
Drop the quotation in at this point.
((to do: ask the binder for the date))
TK: number of plates
Overwrite this text with your own.
Your headline
[Añada una foto del edificio]
Escriba su titular
(dato que debe facilitar el museo)
[Mettez une photo du bâtiment]
(à préciser par le musée)
[Foto des Gebäudes einsetzen]
Überschrift eingeben
(vom Museum zu ergänzen)
[Colocar uma fotografia do edifício]
(a indicar pelo museu)
""".strip().split("\n")

#: Ordinary wordings, written after the last change of the patterns of residue.
LAST_REFUSALS = """
I'm sorry, I can't do that.
Unfortunately, I cannot answer this question.
I'm not able to translate the text you sent.
I won't be responding to this request.
This request falls outside what I am allowed to process.
Sorry, but I'm not permitted to correct this passage.
Lamento no poder responder a su pregunta.
No estoy en posición de traducir este pasaje.
Mis directrices no me permiten contestar.
Je ne suis malheureusement pas en mesure de vous répondre.
Mes directives ne me permettent pas de traduire ce texte.
Je dois malheureusement refuser.
Ich kann Ihnen bei dieser Aufgabe leider nicht helfen.
Es ist mir nicht gestattet, diesen Text zu übersetzen.
Ich muss diese Anfrage leider ablehnen.
Infelizmente, não consigo responder a esta pergunta.
Não me é possível corrigir este trecho.
Purtroppo non posso rispondere alla sua domanda.
Devo rifiutare questa richiesta.
К сожалению, я не могу ответить на ваш вопрос.
Мне не разрешено переводить такие тексты.
很抱歉，我不能回答您的问题。
我没办法翻译这段文字。
申し訳ございませんが、この質問にはお答えできません。
この文章を翻訳することはできません。
माफ़ कीजिए, मैं इस अनुरोध को पूरा नहीं कर सकता।
मैं इस पाठ का अनुवाद नहीं कर सकती।
عذرا، لا أستطيع ترجمة هذا النص.
للأسف لا يمكنني الإجابة عن سؤالك.
ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้
""".strip().split("\n")

LAST_FILLER = """
Aenean lacinia bibendum nulla sed consectetur maecenas faucibus mollis.
This is sample text that will be replaced later.
Placeholder text for the second column.
foo bar baz foo bar baz
Text goes here, text goes here.
Este es un texto de relleno para la página.
Ceci est un texte provisoire pour la mise en page.
Dies ist nur ein Platzhaltertext für die Seite.
Este é um texto de preenchimento para a página.
Questo è un testo di esempio per la pagina.
Это временный текст для страницы.
这是示例文字，请替换。
ここにダミーの文章を入れます。
""".strip().split("\n")

LAST_ERROR_PAGES = """
The page you requested does not exist on this server.
We could not connect to the database server.
Your request has timed out. Please try again.
You do not have permission to view this document.
The file could not be opened because it is damaged.
Login failed: wrong user name or password.
This content is not available in your region.
Sorry, this service is not available right now.
El servidor ha tardado demasiado en responder.
No se pudo abrir el archivo solicitado.
El servicio no está disponible en su región.
Le serveur a mis trop de temps à répondre.
Le fichier demandé n'a pas pu être ouvert.
Ce service n'est pas disponible dans votre région.
Der Server hat zu lange nicht geantwortet.
Die angeforderte Datei konnte nicht geöffnet werden.
O servidor demorou demasiado tempo a responder.
Il file richiesto non può essere aperto.
Сервер слишком долго не отвечает.
您没有权限查看此页面。
このページを表示する権限がありません。
""".strip().split("\n")

LAST_SCRIPT_NOTICES = """
JavaScript has to be enabled before you can read this page.
Turn on JavaScript in the browser settings to see the catalogue.
This website does not work without JavaScript.
Please wait while your browser is being checked.
Cookies are disabled; please enable them to continue.
The reader could not start because scripts are blocked.
Active JavaScript en su navegador para leer esta página.
Este sitio no funciona sin JavaScript.
Espere mientras se comprueba su navegador.
Activez JavaScript dans votre navigateur pour lire cette page.
Ce site ne fonctionne pas sans JavaScript.
Aktivieren Sie JavaScript, um diese Seite zu lesen.
Diese Website funktioniert ohne JavaScript nicht.
Este sítio não funciona sem JavaScript.
Questo sito non funziona senza JavaScript.
Этот сайт не работает без JavaScript.
没有 JavaScript 本网站无法运行。
このサイトは JavaScript がないと動作しません。
""".strip().split("\n")

LAST_INSTRUCTIONS = """
[Insert a photo of the author]
[Write two sentences about the printer]
TODO: add the list of plates.
Type the chapter title here.
(introduction to be written)
Delete this note before publication.
[Inserte una foto del autor]
PENDIENTE: revisar las notas.
(introducción por escribir)
[Insérez une photo de l'auteur]
À FAIRE : vérifier les notes.
[Hier ein Foto des Verfassers einfügen]
TODO: Anmerkungen prüfen.
[Inserir uma fotografia do autor]
A FAZER: rever as notas.
[Inserire una foto dell'autore]
""".strip().split("\n")
