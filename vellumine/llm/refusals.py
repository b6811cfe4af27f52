"""Refusals, by alignment of sentences with templates that have slots.

A template is an order of slots; a slot is a set of phrases of one language: opening (regret, self-description), denied
ability or willingness, act, object, rule, and neutral function words. A sentence is aligned with each template of each
language by the longest common subsequence of its words with a filling of the slots: a dynamic programme over the
sentence's places and the template's slots, which are passed in order. A sentence is a refusal where a denial is among
the aligned phrases and the aligned words are most of its words of content. Denials and acts that stand in another order
than any template's do not align. Languages without blanks are aligned by characters.

An answer is a refusal where most of its sentences, by length, are. A sentence that the passage itself holds is not one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

SHARE = 0.7  # aligned share of a sentence's content
MOST = 0.7  # share of an answer that its refusing sentences are
TOLD = 0.9  # share of a sentence that the passage holds, in order, where it is told there

#: Orders of slots (fixed values): o opening, d denial, a act, b object, r rule, n neutral. A slot repeats and may be empty.
ORDERS = {
    "en": ("o d a b r", "b d a b r", "o b d a b", "r d a b", "o b r", "o a b d a b", "o d b a"),
    "es": ("o d a b r", "o b d a b r", "r d a b", "o b r", "o a b d", "b d a"),
    "fr": ("o d a b r", "o b d a b r", "r d a b", "o b r", "o a b d", "o d b a"),
    "de": ("o d b a r", "o b d b a", "b d o b a", "r d b a", "o b r", "o d a b", "b d a", "r b d b a"),
    "pt": ("o d a b r", "o b d a b r", "r d a b", "o b r", "o a b d"),
    "it": ("o d a b r", "o b d a b r", "r d a b", "o b r", "o a b d"),
    "ru": ("o d a b r", "o b d a b", "r d a b", "o b r", "o b a d", "b d a", "o a b d"),
    "zh": ("o d a b", "o b d a b", "o r d a b", "o b r d a", "r d b a", "o d b a", "o b a d"),
    "ja": ("o b a d", "o b r a d", "o r b a d o", "o d", "b a d o", "o b d a"),
    "hi": ("o b a d", "o d b a", "o b r d", "o b d a d", "o a b d"),
    "ar": ("o d a b r", "o b d a b", "o b r", "b d a"),
    "th": ("o d a b", "o b a d", "o a b d", "o b r", "r d a b", "o d b a", "o b d a"),
}

#: Phrases of the slots (fixed values). '_' stands for up to GAP words of other slots between the parts of a phrase.
SLOTS = {
    "en": {
        "o": "sorry|so sorry|very sorry|i'm sorry|i am sorry|i apologise|i apologize|apologies|my apologies|regrettably|unfortunately|sadly|regretfully|i'm afraid|i am afraid|i regret|forgive me|excuse me|no|thank you|thanks|as an ai|as a language model|as an ai language model|as an assistant|as an ai assistant|being an ai|i understand|however|please understand|for safety reasons|for safety|because|respectfully|politely|i am sorry to say|my answer is|regret to say|unfortunately not",
        "d": "cannot|i cannot|i can't|i can not|can't|i could not|i couldn't|we can't|we cannot|i am unable|i'm unable|we are unable|unable|i am not able|i'm not able|we are not able|not able|i am incapable|not capable|i won't|i will not|i shall not|won't be able|i must decline|i must refuse|i have to decline|i have to refuse|must decline|must refuse|have to decline|i decline|i refuse|decline|refuse|i would rather not|i'd rather not|i prefer not|i would prefer not|i am not allowed|i'm not allowed|not allowed|not permitted|i am not permitted|i'm not permitted|not authorised|not authorized|i am not authorised|i am prohibited|prohibited from|prevented from|barred from|not in a position|i am not in a position|i'm not in a position|i don't feel comfortable|not comfortable|i am not comfortable|i'm not comfortable|i do not wish|i don't want|i am not going|i'm not going|not possible|impossible|is not possible|isn't possible|not something i can|isn't something i can|not something i am able|not something i'm able|beyond what i can|outside what i can|beyond my abilities|beyond my capabilities|outside my capabilities|outside my scope|can't be|cannot be|can not be|do not permit|don't permit|do not allow|don't allow|does not allow|doesn't allow|forbid|forbids|prohibit|prohibits|prevent|prevents|keeps me from|keep me from|no way for me|there is nothing i can|i have no permission|i don't have permission|i do not have permission|i lack the ability|i lack permission|not for me|must abstain|i abstain|must pass|against|goes against|go against|violates|violate|would violate|conflicts with|is contrary to|contrary to|i cannot _ able|outside what i am|outside what i'm|falls outside|off the table|i'll have to pass|have to pass|must pass|no answer can be|break the rules|would break|break|i won't be|won't be|i'm going to sit|sit this one out|a no from me|i must say no|i say no|not going to|someone else|don't have the ability|no can do|isn't allowed|isn't permitted|cannot possibly|can't possibly|i am not in _ position|i can _ not|against my",
        "a": "help|assist|answer|answering|respond|responding|reply|process|processing|handle|handled|handling|translate|translating|rewrite|rewriting|review|reviewing|correct|correcting|provide|providing|complete|completing|completed|comply|fulfil|fulfill|fulfilled|carry|perform|performing|do|doing|done|discuss|discussing|comment|continue|proceed|work|working|deal|engage|offer|give|giving|produce|generate|support|act|accept|accommodate|satisfy|undertake|be of help|please ask|ask|try|make|share|address|summarise|summarize|explain|something i|responding to|producing|rendering|find|doing this|carrying out|sent|be responding|process it",
        "b": "request|requests|this request|task|question|questions|passage|passages|text|texts|content|material|prompt|message|topic|subject|paragraph|translation|answer|answers|response|conversation|instruction|instructions|document|input|information|assistance|something else|another question|kind of|sort of|type of|kind|matter|it|this|that|these|those|such|job|one|rendering|translation you|text you|one out|for me|from me",
        "r": "guidelines|guideline|policy|policies|rules|rule|my programming|principles|terms|standards|instructions|restrictions|safety|regulations|limits",
        "n": "i|i'm|i've|me|my|we|our|us|you|your|to|with|of|on|for|in|at|the|a|an|and|but|so|is|are|am|be|been|any|at this time|here|now|right now|today|further|able|would|will|must|or|as|by|from|about|out|up|if|which|what|want|like|such as|not|do|can|there|ai|into|against",
    },
    "es": {
        "o": "lo siento|lo siento mucho|lo lamento|lamento|lamento decirle|lamento decirte|siento|perdón|perdone|perdona|disculpe|disculpa|disculpas|mis disculpas|lamentablemente|desgraciadamente|desafortunadamente|por desgracia|me temo|como modelo de lenguaje|como modelo de lengua|como ia|como inteligencia artificial|como asistente|siendo una ia|no|gracias|entiendo|por motivos de seguridad|por razones de seguridad|con todo respeto|siento comunicarle|va a ser que no|lamento no|tendrá que disculparme pero",
        "d": "no puedo|no podré|no podría|no podemos|no _ puedo|no me es posible|no es posible|no será posible|no nos es posible|me es imposible|es imposible|imposible|no soy capaz|soy incapaz|no estoy en condiciones|no estoy capacitado|no estoy autorizado|no estoy autorizada|no estoy facultado|no me está permitido|no se me permite|no tengo permitido|no tengo permiso|no tengo autorización|no tengo la capacidad|no está en mis manos|no está a mi alcance|fuera de mi alcance|fuera de mis posibilidades|no me corresponde|prefiero no|preferiría no|me niego|me abstengo|debo abstenerme|debo rechazar|tengo que rechazar|debo negarme|debo declinar|he de rechazar|rechazo|declino|rehúso|no deseo|no quiero|no voy a|no debo|no poder|no puede|no pueden|no permiten|no me permiten|me impiden|impiden|me prohíben|prohíben|va en contra|en contra de|contra|contrario a|contraria a|infringe|viola|incumple|no estoy en posición|no estoy _ posición|no estoy _ condiciones|no procede|no me dejan|queda fuera de|fuera de|no voy|tendrá que disculparme|no _ permiten|no _ es posible|no poder",
        "a": "ayudar|ayudarle|ayudarte|ayudarlo|ayuda|asistir|asistirle|responder|responderle|responderla|contestar|contestarle|procesar|procesarse|traducir|traducirlo|corregir|corregirlo|revisar|cumplir|cumplirse|realizar|realizarse|atender|atenderse|tratar|tratarse|trabajar|hacer|hacerlo|completar|continuar|seguir|proseguir|ofrecer|ofrecerle|proporcionar|dar|darle|comentar|ejecutar|gestionar|satisfacer|hablar|opinar|generar|reescribir|resumir|pregunte|pregúnteme|pregunta|comunicarle|hacerlo|responda|contestar a|a su",
        "b": "petición|solicitud|pasaje|fragmento|texto|contenido|pregunta|tarea|traducción|respuesta|mensaje|conversación|párrafo|tema|asunto|consulta|encargo|material|información|instrucción|otra cosa|documento|este tipo|eso|esto|ello|esta|este|esa|ese",
        "r": "normas|reglas|directrices|política|políticas|pautas|principios|programación|condiciones|restricciones|seguridad|límites",
        "n": "pero|y|o|que|de|del|a|al|la|el|las|los|lo|le|se|me|mi|mis|su|sus|un|una|en|con|por|para|favor|aquí|como|es|yo|no|ni|puede|decir|ahora|más|tal|tales",
    },
    "fr": {
        "o": "désolé|désolée|je suis désolé|je suis désolée|navré|navrée|je suis navré|je regrette|pardon|pardonnez moi|excusez moi|mes excuses|toutes mes excuses|veuillez m'excuser|malheureusement|hélas|je crains|en tant que modèle de langue|en tant que modèle de langage|en tant qu'ia|en tant qu'assistant|en tant qu'intelligence artificielle|je comprends|merci|non|poliment|pour des raisons de sécurité|je crains de devoir|ma réponse|mes excuses mais",
        "d": "je ne peux pas|je ne peux|je ne _ peux|ne peux pas|je ne puis|je ne pourrai pas|je ne pourrais pas|je ne saurais|nous ne pouvons pas|je ne suis pas en mesure|je suis incapable|je suis dans l'incapacité|je ne suis pas capable|je ne suis pas autorisé|je ne suis pas autorisée|je ne suis pas habilité|je n'ai pas le droit|je n'ai pas la possibilité|je n'ai pas l'autorisation|il ne m'est pas possible|il m'est impossible|il n'est pas possible|impossible|il ne m'est pas permis|il m'est interdit|je préfère ne pas|je préférerais ne pas|je refuse|je dois refuser|je dois décliner|je me dois de refuser|je suis contraint de refuser|je suis obligé de refuser|je décline|je m'abstiens|je ne souhaite pas|je ne veux pas|je ne vais pas|ne peut pas|ne peut|ne peut être|ne peuvent pas|ne peuvent|n'est pas possible|n'est pas quelque chose que je peux|n'est pas une chose que je peux|dépasse mes capacités|hors de ma portée|m'interdisent|m'interdit|ne me permettent pas|ne me permet pas|ne m'autorisent pas|m'empêchent|m'empêche|contraire à|contraire aux|va à l'encontre|enfreint|viole|je ne suis _ pas en mesure|ne suis _ en mesure|je dois _ refuser|je dois _ décliner|vous opposer un refus|un refus|ne m'autorise pas|on ne m'autorise pas|ma réponse est non|je ne le ferai pas|sort du cadre|je ne _ pas|je ne peux _ pas|il m'est _ impossible|ne me permettent _ pas|ne permettent pas",
        "a": "aider|aide|assister|répondre|traiter|traité|traitée|traduire|corriger|satisfaire|satisfaite|satisfait|faire|effectuer|accomplir|exécuter|réaliser|compléter|continuer|poursuivre|donner suite|donner|fournir|proposer|commenter|accéder|discuter|m'exprimer|réviser|relire|réécrire|résumer|travailler|posez|demandez|invitation",
        "b": "demande|requête|passage|texte|contenu|question|tâche|traduction|réponse|message|conversation|paragraphe|sujet|extrait|consigne|autre chose|document|ce genre|ce type|cela|ceci|ça|là dessus|ce que je peux|ce paragraphe|de vous",
        "r": "règles|consignes|directives|politique|politiques|principes|programmation|conditions|limites|lignes directrices|normes",
        "n": "mais|et|ou|je|j|vous|à|de|d|du|des|la|le|les|l|ce|c|cet|cette|ces|un|une|en|sur|avec|pour|par|votre|vos|mes|mon|ma|être|est|s'il|plaît|ici|ne|n|pas|que|qu|suis|y|autre|là|une chose|quelque chose",
    },
    "de": {
        "o": "es tut mir leid|tut mir leid|leider|bedauerlicherweise|bedaure|ich bedaure|entschuldigung|entschuldigen sie|verzeihung|verzeihen sie|ich bitte um entschuldigung|ich fürchte|als sprachmodell|als ki|als ki modell|als ki sprachmodell|als künstliche intelligenz|als assistent|ich verstehe|danke|nein|aus sicherheitsgründen",
        "d": "ich kann _ nicht|kann ich _ nicht|kann ich _ keine|ich kann nicht|kann ich nicht|kann nicht|kann leider nicht|ich kann keine|kann _ nicht|können wir nicht|wir können nicht|ich könnte nicht|ich darf nicht|darf ich nicht|darf ich _ nicht|ich darf _ nicht|darf nicht|ich bin nicht in der lage|nicht in der lage|bin ich nicht in der lage|ich bin nicht befugt|nicht befugt|nicht berechtigt|nicht autorisiert|nicht ermächtigt|ich bin außerstande|außerstande|unmöglich|nicht möglich|ist mir nicht möglich|ist es mir nicht möglich|nicht erlaubt|nicht gestattet|untersagt|verboten|muss _ ablehnen|muss ich _ ablehnen|muss ich ablehnen|ablehnen|ich lehne _ ab|lehne ich _ ab|ich lehne es ab|verweigere|ich verweigere|ich weigere mich|weigere ich mich|ich möchte nicht|möchte ich _ nicht|möchte _ nicht|möchte lieber nicht|ich will nicht|ich werde nicht|werde ich nicht|werde _ nicht können|sehe mich nicht in der lage|ich verzichte|erlauben _ nicht|erlauben es mir nicht|gestatten _ nicht|verbieten|untersagen|hindern mich|steht nicht in meiner macht|außerhalb meiner möglichkeiten|übersteigt meine|verstößt gegen|verstoßen gegen|widerspricht|gegen|da muss ich passen|muss ich passen|muss passen|steht mir nicht zu|nicht ausführen|werde _ nicht|die hände gebunden|ist mir _ nicht|ist es mir _ nicht|mir ist _ nicht gestattet|mir ist _ nicht erlaubt|ich kann _ nicht|ich kann _ leider nicht|muss _ leider ablehnen|muss ich _ leider ablehnen|leider nicht",
        "a": "helfen|behilflich sein|behilflich|unterstützen|dienen|beantworten|antworten|bearbeiten|bearbeitet|übersetzen|übersetzt|korrigieren|erfüllen|erfüllt|machen|tun|erledigen|ausführen|nachkommen|entsprechen|liefern|geben|bieten|anbieten|fortfahren|fortsetzen|weitermachen|eingehen|einzugehen|äußern|kommentieren|verarbeiten|behandeln|behandelt|überarbeiten|prüfen|zusammenfassen|annehmen|fragen|stellen|zu bearbeiten|zu beantworten|zu übersetzen|zu antworten|zu erledigen|zu helfen|sein",
        "b": "anfrage|anfragen|stelle|text|texte|inhalt|inhalte|frage|fragen|aufgabe|bitte|wunsch|passage|übersetzung|antwort|nachricht|gespräch|absatz|thema|auftrag|anliegen|dokument|abschnitt|etwas anderes|dabei|damit|hierbei|darauf|dazu|dafür|hiermit|das|dies|diese|diesen|dieser|diesem|dieses|solche|solchen|eine antwort darauf|da|aufgabe leider|dieser aufgabe|bei dieser aufgabe",
        "r": "richtlinien|regeln|vorgaben|vorschriften|grundsätze|bestimmungen|programmierung|prinzipien|grenzen|bedingungen",
        "n": "ich|sie|ihnen|ihre|ihrer|ihren|mir|mich|mein|meine|meinen|meiner|wir|uns|aber|und|oder|es|der|die|den|dem|des|ein|eine|einen|einer|zu|mit|bei|auf|an|in|im|von|für|gerne|gern|lieber|nicht|kein|keine|ist|bin|sich|hier|so|etwas|als|ab",
    },
    "pt": {
        "o": "desculpe|desculpa|desculpas|peço desculpa|peço desculpas|perdão|lamento|lamento muito|sinto muito|lamentavelmente|infelizmente|receio|temo|como modelo de linguagem|como modelo de língua|como ia|como inteligência artificial|como assistente|sendo uma ia|entendo|obrigado|não|por razões de segurança|por motivos de segurança|com todo o respeito",
        "d": "não posso|não poderei|não poderia|não podemos|não _ posso|não consigo|não conseguirei|não sou capaz|sou incapaz|não me é possível|não é possível|não será possível|é impossível|impossível|não me é permitido|não me é autorizado|não estou autorizado|não estou autorizada|não estou habilitado|não estou em condições|não estou em posição|não tenho permissão|não tenho autorização|não tenho como|não tenho a capacidade|não tenho condições|prefiro não|preferia não|preferiria não|recuso|recuso me|me recuso|devo recusar|tenho de recusar|tenho que recusar|preciso recusar|declino|devo declinar|abstenho me|não desejo|não quero|não vou|não devo|não pode|não podem|não permitem|não me permitem|impedem me|me impedem|proíbem|está fora do que posso|fora do meu alcance|fora das minhas possibilidades|além das minhas capacidades|vai contra|contra|contrário a|contraria|viola|infringe|terei de declinar|terei de recusar|terei que recusar|fico impedido|estou impedido|não vou|não _ é possível|não _ permitem|não estou em posição|este convite",
        "a": "ajudar|ajudá lo|ajudá la|ajuda|auxiliar|assistir|responder|processar|processado|traduzir|corrigir|rever|revisar|atender|cumprir|realizar|realizada|realizado|fazer|fazê lo|executar|completar|continuar|prosseguir|oferecer|fornecer|dar|comentar|tratar|tratado|satisfazer|satisfeito|trabalhar|reescrever|resumir|pergunte|faça",
        "b": "pedido|solicitação|trecho|texto|conteúdo|pergunta|tarefa|tradução|resposta|mensagem|conversa|parágrafo|tema|assunto|questão|passagem|excerto|instrução|documento|outra coisa|este tipo|esse tipo|isso|isto|esse|este|essa|esta",
        "r": "regras|diretrizes|normas|política|políticas|orientações|princípios|programação|condições|limites|restrições|segurança",
        "n": "mas|e|ou|que|de|do|da|dos|das|a|o|os|as|ao|à|um|uma|em|no|na|com|por|para|por favor|seu|sua|me|mim|meu|minhas|meus|minha|eu|lhe|se|aqui|com esta|com este|com isso|como|ser|é|está",
    },
    "it": {
        "o": "mi dispiace|mi spiace|spiacente|sono spiacente|scusi|scusa|scusate|mi scuso|chiedo scusa|le mie scuse|purtroppo|sfortunatamente|temo|temo di|mi rincresce|come modello linguistico|come modello di lingua|come ia|come intelligenza artificiale|come assistente|in quanto ia|in quanto modello linguistico|capisco|grazie|no|per motivi di sicurezza",
        "d": "non posso|non potrò|non potrei|non possiamo|non _ posso|non riesco|non sono in grado|sono incapace|non sono capace|non mi è possibile|non è possibile|mi è impossibile|è impossibile|impossibile|non mi è consentito|non mi è permesso|non sono autorizzato|non sono autorizzata|non sono abilitato|non ho il permesso|non ho la possibilità|non ho l'autorizzazione|non ho modo|non poter|non potere|preferisco non|preferirei non|mi rifiuto|rifiuto|devo rifiutare|devo declinare|declino|mi astengo|devo astenermi|non desidero|non voglio|non intendo|non me la sento|non devo|non può|non può essere|non possono|non mi permettono|non permettono|non mi consentono|non consentono|mi impediscono|mi vietano|esula dalle mie|va oltre le mie|fuori dalla mia portata|non rientra|contraria alle|contrario alle|è contraria|contro le|contro|va contro|viola|mi vedo costretto a rifiutare|sono costretto a rifiutare|costretto a rifiutare|costretta a rifiutare|non intendo|esula dalle|esula|non _ è possibile|non sono in condizione|non mi sento",
        "a": "aiutare|aiutarla|aiutarti|aiuto|assistere|rispondere|elaborare|tradurre|correggere|rivedere|soddisfare|soddisfatta|soddisfatto|fare|farlo|svolgere|eseguire|completare|continuare|proseguire|procedere|offrire|fornire|dare|commentare|trattare|trattato|accogliere|esaudire|lavorare|riscrivere|riassumere|chieda|chiedi|chiedere|evadere",
        "b": "richiesta|brano|testo|contenuto|contenuti|domanda|compito|traduzione|risposta|messaggio|conversazione|paragrafo|argomento|tema|passo|passaggio|documento|istruzione|qualcos altro|altro|questo tipo|questo genere|questo|questa|ciò|quello|possibilità|competenze|questo compito|alla sua",
        "r": "linee guida|regole|norme|politiche|direttive|principi|programmazione|condizioni|limiti|restrizioni",
        "n": "ma|e|o|di|a|ad|al|alla|alle|da|in|con|per|per favore|il|lo|la|le|i|gli|l|un|una|uno|su|sua|suo|mi|mie|mio|mia|miei|io|la sua|che|è|essere|qui|non|ci|si|tale",
    },
    "ru": {
        "o": "извините|простите|прошу прощения|приношу извинения|сожалею|мне жаль|очень жаль|жаль|к сожалению|увы|боюсь|боюсь что|как языковая модель|как ии|как искусственный интеллект|как ассистент|будучи языковой моделью|я понимаю|спасибо|нет|по соображениям безопасности",
        "d": "не могу|не смогу|не сможем|не можем|не в состоянии|не способен|не способна|не готов|не готова|не вправе|не имею права|не имею возможности|не имею разрешения|не уполномочен|не уполномочена|не буду|не стану|не хочу|не хотел бы|не желаю|предпочёл бы не|предпочел бы не|предпочту не|предпочитаю не|нельзя|невозможно|мне нельзя|мне запрещено|запрещено|мне не разрешено|не разрешено|не разрешается|не позволено|не положено|не допускается|вынужден отказаться|вынуждена отказаться|вынужден отказать|вынужден отклонить|должен отказаться|должен отказать|должна отказаться|придётся отказаться|придется отказать|отказываюсь|отклоняю|воздержусь|воздерживаюсь|не может быть|не могут быть|не позволяют|не позволяет|не разрешают|запрещают|запрещает|вне моих возможностей|за пределами моих возможностей|не в моих силах|противоречит|нарушает|против|вынужден ответить отказом|ответить отказом|не позволено|мне не позволено|сделать не могу|не _ могу|не буду|не стану",
        "a": "помочь|помогать|помощь|выполнить|выполнен|выполнена|выполнять|обработать|обрабатывать|обработан|перевести|переводить|ответить|отвечать|исправить|исправлять|сделать|делать|продолжать|продолжить|комментировать|прокомментировать|предоставить|дать|обсуждать|обсудить|заняться|работать|закончить|переписать|проверить|поддержать|удовлетворить|удовлетворён|спросите|спросить",
        "b": "просьбу|просьба|запрос|запросу|запросом|отрывок|текст|текста|текстом|вопрос|вопросы|вопросом|задача|задачу|задачей|задание|содержание|содержимое|перевод|ответ|сообщение|тему|тема|абзац|фрагмент|разговор|материал|что нибудь другое|что то другое|другое|это|этого|этим|этот|эту|этой|этом|такое|такой|такие",
        "r": "правила|правилам|правилами|правил|принципам|принципы|политике|политика|инструкциям|инструкции|ограничения|нормам|руководства",
        "n": "но|и|или|я|мне|меня|мои|моим|мой|моих|вам|вас|ваш|вашу|вашей|ваша|данный|данную|с|со|на|в|по|о|об|для|к|что|бы|пожалуйста|здесь|быть|так|как|же|не",
    },
    "zh": {
        "o": "抱歉|很抱歉|非常抱歉|对不起|不好意思|请原谅|请见谅|见谅|遗憾|很遗憾|可惜|恐怕|作为语言模型|作为一个语言模型|作为人工智能|作为ai|作为助手|作为一个|身为|我理解|谢谢|出于安全|出于安全考虑|恕|请见谅|见谅",
        "d": "无法|不能|不能够|不可以|不可|没法|没办法|没有办法|没有权限|无权|不便|不方便|不允许|不被允许|未被允许|不许|不予|不会|不想|不愿|不愿意|宁愿不|宁可不|拒绝|必须拒绝|只能拒绝|婉拒|谢绝|恕不|恕难|难以|做不到|帮不了|帮不上|办不到|从命|不得|禁止|违反|违背|不符合|超出|有悖|超出了|超出|不会|我拒绝",
        "a": "协助|帮助|帮|帮忙|处理|回答|回应|回复|答复|作答|翻译|修改|改写|校对|更正|提供|完成|执行|满足|继续|讨论|评论|进行|做|作出|给出|支持|参与|接受|总结|请问|问|询问",
        "b": "请求|要求|文字|段落|段文字|文本|内容|问题|任务|翻译|回答|答案|话题|消息|对话|材料|信息|文章|别的|其他|其他问题|您|你|这个忙|忙|这样|这|这个|这段|此|该|这项|这些|此类|这类|能力范围|能力",
        "r": "规定|根据规定|准则|使用准则|规则|政策|原则|指南|指引|条款|规范",
        "n": "我|我们|您|你|您的|你的|的|了|但|但是|而|对|对此|于|此|所|来|去|地|这|个|段|为|与|和|被|让|给|请|在|里|项|也|会|将|能|是|有|事|我的|们|不了",
    },
    "ja": {
        "o": "申し訳ありませんが|申し訳ありません|申し訳ございませんが|申し訳ございません|すみませんが|すみません|ごめんなさい|ごめん|恐れ入りますが|恐縮ですが|残念ながら|残念ですが|あいにく|遺憾ながら|言語モデルとして|aiとして|人工知能として|アシスタントとして|失礼ですが|お詫びします",
        "d": "できません|できない|できかねます|出来ません|いたしかねます|致しかねます|しかねます|かねます|お応えできません|応えられません|応じられません|答えられません|お答えできません|行えません|行えない|不可能です|不可能|無理です|困難です|お断りします|お断りいたします|お断り|断らせていただきます|辞退します|辞退いたします|拒否します|控えます|差し控えます|差し控えさせていただきます|控えさせていただきます|遠慮します|遠慮させていただきます|許可されていません|許されていません|認められていません|許可がありません|禁止されています|権限がありません|力になれません|なれません|お受けできません|受けられません|沿えません|沿うことができず|できず|能力を超えています|範囲外です|範囲を超えています|反します|反する|違反します|違反する|たくありません|答えたくありません|ことはできません|お引き受けできません|引き受けられません|することはできません|できませんでした",
        "a": "お手伝い|手伝い|手伝う|協力|支援|対応|処理|翻訳|回答|返答|返信|答える|お答え|応える|応じる|修正|訂正|添削|提供|実行|遂行|完了|続行|続ける|議論|説明|要約|する|行う|助ける|書き換え|受ける|沿う|お尋ね|質問して|聞いて|ください|引き受け|お引き受け|お答えする|答え",
        "b": "ご依頼|依頼|ご要望|要望|ご要求|要求|リクエスト|文章|文|テキスト|本文|内容|コンテンツ|質問|ご質問|問題|課題|タスク|作業|件|この件|話題|トピック|段落|箇所|会話|それ|これ|その|この|そのような|このような|こと|もの|別のこと|ほか|他",
        "r": "ガイドライン|規則|規約|ポリシー|方針|ルール|原則|規定|制限",
        "n": "私|わたし|には|に|は|を|が|の|も|で|と|へ|ご|お|ため|ので|から|ます|です|ん|して|ません|させて|いただき|いただけません|よう|ような|ついて|について|ついては|対して|何|か|く|る|い",
    },
    "hi": {
        "o": "क्षमा करें|क्षमा कीजिए|क्षमा|माफ़ करें|माफ करें|माफ़ कीजिए|माफ कीजिए|माफ़ी|माफी|खेद है|मुझे खेद है|खेद है कि|अफ़सोस|अफसोस|दुर्भाग्य से|दुर्भाग्यवश|एक भाषा मॉडल के रूप में|भाषा मॉडल के रूप में|भाषा मॉडल होने के नाते|एआई के रूप में|सहायक के रूप में|कृत्रिम बुद्धिमत्ता के रूप में|मैं समझता हूँ|धन्यवाद|नहीं|सुरक्षा कारणों से",
        "d": "नहीं कर सकता|नहीं कर सकती|नहीं कर सकते|नहीं दे सकता|नहीं दे सकती|नहीं सकता|नहीं सकती|नहीं कर पाऊँगा|नहीं कर पाऊँगी|नहीं कर पाऊंगा|नहीं दे पाऊँगा|नहीं हो पाएगा|नहीं हो सकता|नहीं हो सकेगा|नहीं किया जा सकता|नहीं करूँगा|नहीं करूंगा|नहीं दूँगा|संभव नहीं|संभव नहीं है|सम्भव नहीं|असंभव|असमर्थ|असमर्थ हूँ|असमर्थ हूं|अक्षम|सक्षम नहीं|योग्य नहीं|अनुमति नहीं|अनुमति नहीं है|की अनुमति नहीं|इजाज़त नहीं|इजाजत नहीं|अधिकार नहीं|अधिकृत नहीं|मना करना|मना करता|मना करती|मना है|इनकार|इनकार करता|इंकार|अस्वीकार|अस्वीकार करता|नहीं चाहता|नहीं चाहती|नहीं चाहूँगा|देना नहीं चाहता|करना नहीं चाहता|नहीं देते|अनुमति नहीं देते|रोकते|मेरे बस में नहीं|मेरी क्षमता से बाहर|के विरुद्ध|विरुद्ध|के खिलाफ|खिलाफ|ख़िलाफ़|उल्लंघन|नहीं करूँगी|मना किया गया|मना किया गया है|पूरा नहीं कर सकता|नहीं कर सकूँगा",
        "a": "सहायता|मदद|उत्तर|जवाब|अनुवाद|संसाधित|संशोधित|ठीक|सुधार|पूरा|पूरी|काम|कार्य|प्रदान|जारी|चर्चा|टिप्पणी|करना|करने|देना|देने|रखना|रखने|लिखना|सारांश|पूछें|पूछिए",
        "b": "अनुरोध|अनुरोध को|प्रश्न|सवाल|पाठ|अंश|अनुच्छेद|सामग्री|विषय|कार्य|काम|संदेश|बातचीत|प्रकार|कुछ और|दस्तावेज़|निवेदन|इस|यह|इसका|इसकी|इसे|ऐसा|ऐसी|आपकी|आपके|आप",
        "r": "नियमों|नियम|दिशानिर्देशों|दिशानिर्देश|नीति|नीतियों|सिद्धांतों",
        "n": "मैं|मुझे|मुझसे|मेरे|मेरी|मेरा|लिए|के|का|की|को|में|से|पर|है|हूँ|हूं|हैं|होगा|कि|और|लेकिन|परंतु|किंतु|तो|एक|ने|भी|हो|था|इस|कर|यहाँ|किसी|नहीं",
    },
    "ar": {
        "o": "عذرا|عذراً|آسف|آسفة|أنا آسف|أعتذر|أعتذر منك|اعتذر|المعذرة|معذرة|أرجو المعذرة|سامحني|للأسف|مع الأسف|لسوء الحظ|يؤسفني|يؤسفني أنني|أخشى|أخشى أنني|بصفتي نموذجا لغويا|بصفتي نموذج لغة|بصفتي مساعدا|بصفتي مساعدا آليا|بصفتي ذكاء اصطناعيا|كنموذج لغوي|كوني نموذجا لغويا|أفهم|شكرا|لا|لأسباب أمنية",
        "d": "لا يمكنني|لا يمكننا|لا يمكن|لن يمكنني|لا أستطيع|لا استطيع|لن أستطيع|لا نستطيع|لن أتمكن|لا أتمكن|لم أتمكن|لا أقدر|لن أقدر|غير قادر|غير قادرة|أنا غير قادر|لست قادرا|لست قادرة|عاجز عن|أعجز عن|ليس بإمكاني|ليس في وسعي|ليس بوسعي|ليس من الممكن|من غير الممكن|غير ممكن|مستحيل|يستحيل|يتعذر|يتعذر علي|لا يسمح لي|لا يسمح|غير مسموح|غير مسموح لي|غير مخول|لست مخولا|لا يحق لي|لا يجوز|لا يجوز لي|ممنوع|يمنع|محظور|لا أملك صلاحية|لا أملك الصلاحية|ليس لدي إذن|أرفض|مضطر إلى الرفض|مضطر للرفض|علي أن أرفض|يجب أن أرفض|علي الرفض|أفضل عدم|أفضل ألا|أفضل أن لا|أمتنع|أمتنع عن|لا أريد|لا أرغب|لن أقوم|لا تسمح|لا تسمح لي|تمنعني|تحظر|خارج قدرتي|خارج قدراتي|خارج نطاق|يتجاوز قدرتي|يخالف|تخالف|يتعارض مع|تتعارض مع|ضد|ينتهك|لن أجيب|لست مخولا|لن أترجم|لن أقوم",
        "a": "المساعدة|مساعدة|مساعدتك|مساعدتكم|معالجة|الإجابة|إجابة|أجيب|الرد|ترجمة|بترجمة|الترجمة|تصحيح|تنفيذ|تلبية|إكمال|إتمام|متابعة|المتابعة|الاستمرار|تقديم|التعليق|مناقشة|القيام|فعل|أفعل|كتابة|إعادة كتابة|تلخيص|مراجعة|العمل|اسأل|اسألني|بمعالجة",
        "b": "الطلب|طلب|طلبك|طلبكم|النص|نص|المقطع|السؤال|الأسئلة|المحتوى|المهمة|الموضوع|الرسالة|الفقرة|الترجمة|الجواب|المحادثة|المادة|ما طلبته|شيء آخر|شيئا آخر|الأمر|هذا|هذه|ذلك|تلك|بذلك|به|بهذا|النوع|سؤالك",
        "r": "القواعد|قواعدي|قواعد|الإرشادات|إرشاداتي|التعليمات|تعليماتي|السياسات|سياسة|سياساتي|المبادئ|مبادئي|المعايير|الشروط|الخاصة بي",
        "n": "لكن|لكنني|ولكن|ولكنني|أنا|أنني|إني|في|على|عن|من|إلى|ب|مع|أن|إن|و|أو|ما|لي|لك|لكم|هنا|هو|هي|كان|قد|هل|عليك|علي",
    },
    "th": {
        "o": "ขออภัย|ขออภัยค่ะ|ขออภัยครับ|ขอโทษ|ขอโทษค่ะ|ขอโทษครับ|ขอโทษด้วย|เสียใจด้วย|เสียใจ|น่าเสียดาย|น่าเสียดายที่|ต้องขออภัย|ในฐานะแบบจำลองภาษา|ในฐานะโมเดลภาษา|ในฐานะปัญญาประดิษฐ์|ในฐานะผู้ช่วย|ขอบคุณ|เกรงว่า|ด้วยเหตุผลด้านความปลอดภัย",
        "d": "ไม่สามารถ|ไม่อาจ|ไม่ได้|ไม่ได้รับอนุญาต|ไม่ได้รับอนุญาตให้|ไม่อนุญาต|ไม่อนุญาตให้|ไม่มีสิทธิ์|ไม่มีสิทธิ|ไม่มีอำนาจ|ไม่สะดวก|ไม่สะดวกที่จะ|ไม่ประสงค์|ไม่ต้องการ|ไม่อยาก|ไม่ขอ|ขอไม่|ไม่พร้อม|ปฏิเสธ|ขอปฏิเสธ|ต้องปฏิเสธ|จำเป็นต้องปฏิเสธ|ต้องขอปฏิเสธ|งดตอบ|ของด|เป็นไปไม่ได้|ทำไม่ได้|ช่วยไม่ได้|ตอบไม่ได้|แปลไม่ได้|ห้าม|ถูกห้าม|เกินความสามารถ|นอกเหนือขอบเขต|ขัดต่อ|ขัดกับ|ละเมิด|ผิดต่อ|ฝ่าฝืน|เลือกที่จะไม่|คงต้องขอปฏิเสธ|คงต้องปฏิเสธ|ไม่ขอตอบ|คงช่วยไม่ได้",
        "a": "ช่วย|ช่วยเหลือ|ประมวลผล|ตอบ|ตอบคำถาม|แปล|แก้ไข|ทำ|ทำงาน|ดำเนินการ|ให้|จัดการ|สนับสนุน|พูดคุย|ให้ความเห็น|ทำต่อ|ดำเนินต่อ|สรุป|เขียน|ถาม|ตรวจ|จะ|อนุญาต",
        "b": "คำขอ|คำร้อง|คำร้องขอ|ข้อความ|เนื้อหา|คำถาม|งาน|เรื่อง|หัวข้อ|บทความ|ย่อหน้า|คำตอบ|คำแปล|การสนทนา|คำสั่ง|เรื่องอื่น|อย่างอื่น|คุณ|ท่าน|นี้|นั้น|ดังกล่าว|แบบนี้|สิ่งนี้|ส่วนนี้",
        "r": "กฎ|กฎของฉัน|แนวทาง|แนวปฏิบัติ|นโยบาย|ข้อกำหนด|หลักการ|กฎเกณฑ์|ระเบียบ|ข้อจำกัด",
        "n": "ฉัน|ผม|ดิฉัน|เรา|ของ|ของฉัน|ที่|ที่จะ|ใน|กับ|ต่อ|ตาม|แก่|และ|แต่|ค่ะ|ครับ|คะ|นะ|ด้วย|ก็|เป็น|มี|ได้|ต้อง|ว่า|การ|ความ|ข้อ|ต่อไป|จึง|ให้",
    },
}

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[฀-๿]|[^\W_](?:[^\W_]|[̀-ͯऀ-ःऺ-ॏ॑-ॗॢॣً-ٟ])*")
_SENT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।؟])\s*|\n+")
GAP = 6  # words of other slots inside a phrase with '_'


def tokens(text: str) -> list[str]:
    low = unicodedata.normalize("NFKC", text).lower().replace("’", "'")
    return _WORD.findall(low)


class Language:
    """The phrases of one language's slots, indexed by their first word, and its templates."""

    def __init__(self, code: str) -> None:
        self.first: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        self.split: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {}
        for slot, phrases in SLOTS[code].items():
            for p in phrases.split("|"):
                parts = [tuple(tokens(x)) for x in p.split("_")]
                if len(parts) == 2:
                    self.split.setdefault(parts[0][0], []).append((parts[0], parts[1]))
                else:
                    self.first.setdefault(parts[0][0], []).append((parts[0], slot))
        self.denials = {p[0][0] for ps in self.first.values() for p in ps if p[1] == "d"} | set(self.split)
        self.orders = [tuple(o.split()) for o in ORDERS[code]]

    def phrases(self, words: list[str]) -> list[list[tuple[int, str, int]]]:
        """Of each place, (end, slot, words inside that other slots fill) of the phrases that begin there."""
        out: list[list[tuple[int, str, int]]] = []
        for i, w in enumerate(words):
            here = [(i + len(p), slot, 0) for p, slot in self.first.get(w, ()) if tuple(words[i : i + len(p)]) == p]
            for a, b in self.split.get(w, ()):
                if tuple(words[i : i + len(a)]) == a:
                    for gap in range(1, GAP + 1):
                        j = i + len(a) + gap
                        if tuple(words[j : j + len(b)]) == b:
                            inside = words[i + len(a) : j]
                            known = sum(x in self.first for x in inside)
                            here.append((j + len(b), "d", gap - known))
            out.append(here)
        return out

    def aligned(self, words: list[str]) -> float:
        """The best share of a sentence's content that aligns with a template, a denial among it; else 0."""
        if not any(w in self.denials for w in words):
            return 0.0
        here = self.phrases(words)
        if not any(slot == "d" for ps in here for _, slot, _ in ps):
            return 0.0
        return max(self._align(words, here, order) for order in self.orders)

    def _align(self, words: list[str], here: list[list[tuple[int, str, int]]], order: tuple[str, ...]) -> float:
        # state: (slot reached, whether a denial was aligned) -> (missed, matched) content words; fewest missed wins
        n = len(words)
        table: list[dict[tuple[int, bool], tuple[int, int]]] = [{} for _ in range(n + 1)]
        table[0][0, False] = (0, 0)

        def put(at: int, key: tuple[int, bool], value: tuple[int, int]) -> None:
            old = table[at].get(key)
            if old is None or (value[0], -value[1]) < (old[0], -old[1]):
                table[at][key] = value

        for i in range(n):
            for (s, denied), (missed, matched) in list(table[i].items()):
                put(i + 1, (s, denied), (missed + 1, matched))
                for end, slot, gap in here[i]:
                    if slot == "n":
                        put(end, (s, denied), (missed, matched))
                        continue
                    for t in range(s, len(order)):
                        if order[t] == slot:
                            put(end, (t, denied or slot == "d"), (missed + gap, matched + end - i - gap))
                            break
        best = 0.0
        for (_, denied), (missed, matched) in table[n].items():
            if denied and matched:
                best = max(best, matched / (matched + missed))
        return best


_LANGUAGES: dict[str, Language] = {}


def languages() -> Iterable[Language]:
    if not _LANGUAGES:
        _LANGUAGES.update({c: Language(c) for c in SLOTS})
    return _LANGUAGES.values()


@lru_cache(100_000)
def refuses(sentence: str) -> bool:
    """Whether a sentence aligns with a refusal template of some language."""
    words = tokens(sentence)
    return any(lang.aligned(words) >= SHARE for lang in languages())


def sentences(answer: str) -> list[str]:
    return [s for s in _SENT.split(answer) if s and s.strip()]


def is_refusal(answer: str, told: str = "") -> bool:
    """Whether most of an answer's sentences align with refusal templates. told: the passage, whose sentences are none."""
    said = total = 0
    held = None
    for s in sentences(answer):
        size = len(s.strip())
        total += size
        if refuses(s):
            if told:
                held = held if held is not None else {tuple(tokens(x)) for x in sentences(told)}
                mine = tuple(tokens(s))
                if mine in held or (len(mine) > 2 and any(_inside(mine, x) for x in held)):
                    continue
            said += size
        elif _closing(s):
            total -= size
    return bool(total > 0) and said / total >= MOST


def _inside(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether most of a stands in b as one run."""
    need = max(1, int(TOLD * len(a)))
    runs = {b[i : i + need] for i in range(len(b) - need + 1)}
    return any(a[i : i + need] in runs for i in range(len(a) - need + 1))


def _closing(sentence: str) -> bool:
    """Whether a sentence has nothing but openings, acts, objects and neutral words: what stands beside a refusal."""
    words = tokens(sentence)
    if not words:
        return False
    for lang in languages():
        here = lang.phrases(words)
        reach = [True] + [False] * len(words)
        for i in range(len(words)):
            if reach[i]:
                for end, _, gap in here[i]:
                    if not gap:
                        reach[end] = True
        if reach[-1]:
            return True
    return False
