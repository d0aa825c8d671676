"""Texts written before the phrase lists were widened, and never used to widen them: recall and precision are measured on them."""

RESIDUE = [
    "500 Internal Server Error - Apache",
    "The requested URL was not found on this server.",
    "We couldn't load this lesson. Please try again later.",
    "This site can't be reached.",
    "Your connection timed out.",
    "Access to this page has been denied.",
    "The server is temporarily unable to service your request.",
    "This page has been removed.",
    "Die angeforderte Seite existiert nicht.",
    "Diese Seite konnte nicht geladen werden.",
    "La page que vous cherchez est introuvable.",
    "La página solicitada no existe.",
    "A página que procura não existe.",
    "La pagina richiesta non esiste.",
    "De opgevraagde pagina bestaat niet.",
    "Żądana strona nie istnieje.",
    "Запрошенная страница не существует.",
    "Too many requests. Please try again in a few minutes.",
    "You are not authorized to view this content.",
    "Please complete the security check to continue.",
    "JavaScript must be enabled to view this website.",
    "This application requires JavaScript to run.",
    "We're sorry, but this site doesn't work properly without JavaScript enabled.",
    "Ihr Browser unterstützt kein JavaScript.",
    "Votre navigateur ne prend pas en charge JavaScript.",
    "Su navegador no admite JavaScript.",
    "Il tuo browser non supporta JavaScript.",
    "Uw browser ondersteunt geen JavaScript.",
    "Your text goes here.",
    "Add your description here",
    "Title goes here",
    "This section is still to be written.",
    "Content will be added soon.",
    "Hier steht bald ein Text.",
    "Beschreibung folgt.",
    "Contenu bientôt disponible.",
    "Contenido en preparación.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.",
    "Dear {{first_name}}, thank you for joining.",
    "This module was written by %AUTHOR%.",
    "Course starts on {{ start_date }} in room {{ room }}.",
    "Hello ${userName}, set up your environment first.",
    "Welcome to {{course_name}}, where every variable is explained.",
    "Learn more about <%= @course.title %> today.",
    "Price: undefined",
    "Last edited by null on NaN.",
    "[Your name here]",
]
CONTENT = [
    "Set the header to {token} before you send the request.",
    "Replace ${VERSION} with the number of your release.",
    "The template engine replaces {{ user }} with the name of the user.",
    "Type %s where the name should stand.",
    "Press {Enter} twice.",
    "Every {{ needs a matching }} on the same line.",
    "The placeholder {id} stands for the number of the order.",
    "A variable such as ${PATH} is read by the shell.",
    "Assign null to the field to clear it.",
    "The function returns undefined if the key is missing.",
    "Compare the result to NaN with isNaN.",
    "A request for a missing page gives the status 404.",
    "The server answers 503 while the pods restart.",
    "If the file does not exist, the build creates it.",
    "Access is denied unless the role has the permission.",
    "An internal server error usually means that the log has a stack trace.",
    "Log in to the registry before you push the image.",
    "JavaScript runs in the browser and on the server.",
    "Enable scripts in the policy file and restart the agent.",
    "The scripts folder holds one file for each stage.",
    "You need JavaScript skills for the second half of the course.",
    "Todo lists are a common first project.",
    "Write a test for each placeholder in the template.",
    "The loading time grows with the number of images.",
    "More chapters come soon after the first release.",
    "Lorem ipsum is a text that printers have used for centuries.",
    "The word test stands in the name of each test file.",
    "Der Fehler tritt auf, wenn die Seite nicht gefunden wird und der Cache leer ist.",
    "La page d'accueil montre la liste des cours.",
    "El servidor responde con un error si falta la clave.",
    "Strona zawiera listę wszystkich kursów.",
    "Сервер возвращает ошибку, если ключ не найден.",
    "Omnes viae Romam ducunt is a proverb about roads.",
    "Please try the exercise again with a smaller file.",
    "The page you are looking for is in the second chapter.",
    "Your browser shows the certificate when you click the lock.",
    "This page explains how a gateway passes requests on.",
    "Sign in to the console and open the second tab.",
    "The session expired event is sent after an hour.",
    "Add your own description to the manifest and push it.",
]
