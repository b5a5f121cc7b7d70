"""Inspected examples: blocks of text, written for this purpose after reading what such corpora hold, with the class that they belong to.

Fixed values. The first item of a row is its class, the second its family; the mean statistics of a family start one component.
"""

EXAMPLES: list[tuple[str, str, str]] = [
    ("prose", "sentence", "The installer asks for a password although nothing in the manual mentions it."),
    ("prose", "sentence", "Nach dem letzten Neustart war die Ausgabe leer, und niemand weiß warum."),
    ("prose", "sentence", "Je n’ai pas trouvé la cause, mais le journal ne montre aucune erreur."),
    ("prose", "sentence", "¿Alguien puede decirme por qué el programa no se abre en mi equipo?"),
    ("prose", "sentence", "Could somebody tell me whether the old release still works with this library?"),
    ("prose", "paragraph", "I tried the new release this morning and it did not start. The log says that a file is missing, which is odd because the package lists it. After a second attempt I went back to the version of last week, and that one works. Has anyone else seen this, or is it only my machine?"),
    ("prose", "paragraph", "Ich habe die neue Ausgabe heute früh versucht, und sie startet nicht. Im Protokoll steht, dass eine Datei fehlt. Danach bin ich zur alten Fassung zurück, und die läuft. Hat das noch jemand gesehen, oder liegt es an mir?"),
    ("prose", "paragraph", "J’ai essayé la nouvelle version ce matin, et elle ne démarre pas. Le journal dit qu’il manque un fichier, ce qui est étrange. Je suis donc revenu à la version de la semaine dernière, et celle-ci fonctionne. Est-ce que quelqu’un a vu la même chose ?"),
    ("prose", "paragraph", "He probado la nueva versión esta mañana y no arranca. El registro dice que falta un archivo, lo que es raro porque el paquete lo incluye. Por eso he vuelto a la versión de la semana pasada, y esa funciona. ¿Alguien más lo ha visto?"),
    ("prose", "wrapped", "The build takes far longer than it did before the change, and I am not\nsure that it is worth the wait. We should ask the people who wrote the\nfirst recipe what they had in mind when they chose that option, since\nnobody here can remember the reason for it any more."),
    ("prose", "wrapped", "> The build takes far longer than it did before the change, and I am\n> not sure that it is worth the wait. We should ask the people who\n> wrote the first recipe what they had in mind, since nobody here can\n> remember the reason."),
    ("prose", "wrapped", "Der Bau dauert viel länger als vor der Änderung, und ich bin mir nicht\nsicher, dass sich das lohnt. Wir sollten die Leute fragen, die das erste\nRezept geschrieben haben, denn hier weiß es niemand mehr, und im Text\nsteht dazu auch nichts."),
    ("prose", "wrapped", "La compilation dure bien plus longtemps qu’avant le changement, et je ne\nsuis pas sûr que cela en vaille la peine. Il faudrait demander à ceux qui\nont écrit la première recette, car personne ici ne se souvient de la\nraison de ce choix."),
    ("prose", "careless", "i tried the new release this morning and it did not start the log says that a file is missing which is odd because the package lists it after a second attempt i went back to the version of last week and that one works has anyone else seen this or is it only my machine"),
    ("prose", "careless", "ich habe die neue ausgabe heute früh versucht und sie startet nicht im protokoll steht dass eine datei fehlt danach bin ich zur alten fassung zurück und die läuft hat das noch jemand gesehen oder liegt es nur an mir und meinem rechner"),
    ("prose", "careless", "he probado la nueva versión esta mañana y no arranca el registro dice que falta un archivo lo que es raro porque el paquete lo incluye por eso he vuelto a la versión de la semana pasada y esa funciona en mi equipo sin más"),
    ("prose", "careless", "j’ai essayé la nouvelle version ce matin et elle ne démarre pas le journal dit qu’il manque un fichier ce qui est étrange je suis donc revenu à la version de la semaine dernière et celle-ci fonctionne sans souci"),
    ("prose", "upper", "THE INSTALLER ASKS FOR A PASSWORD ALTHOUGH NOTHING IN THE MANUAL MENTIONS IT. I WENT BACK TO THE VERSION OF LAST WEEK, AND THAT ONE WORKS."),
    ("prose", "upper", "NACH DEM LETZTEN NEUSTART WAR DIE AUSGABE LEER, UND NIEMAND WEISS WARUM. ICH HABE DIE ALTE FASSUNG BEHALTEN, UND DIE LÄUFT BEI MIR."),
    ("prose", "upper", "I DO NOT KNOW WHY THE OLD RELEASE STILL WORKS WITH THIS LIBRARY, BUT IT DOES."),
    ("prose", "lines", "The installer asks for a password.\nNobody has told me which one it wants.\nI went back to the version of last week, and that one works.\nIs there a reason for this change?"),
    ("prose", "lines", "Nach dem Neustart war die Ausgabe leer.\nNiemand weiß, warum das so ist.\nIch habe die alte Fassung behalten, und die läuft bei mir.\nGibt es dafür einen Grund?"),
    ("list", "marked sentences", "- The installer asks for a password although nothing mentions it.\n- I went back to the version of last week, and that one works.\n- Nobody knows why the output was empty after the restart."),
    ("list", "marked sentences", "* Je n’ai pas trouvé la cause, mais le journal ne montre rien.\n* Je suis revenu à la version de la semaine dernière.\n* Personne ne sait pourquoi la sortie était vide."),
    ("list", "marked sentences", "• Nach dem Neustart war die Ausgabe leer, und niemand weiß warum.\n• Ich habe die alte Fassung behalten, und die läuft bei mir.\n• Wir sollten die Leute fragen, die das Rezept geschrieben haben."),
    ("list", "marked sentences", "* If the installer asks for a password, then the manual probably has to say so as well."),
    ("list", "marked names", "- libquartz-git\n- python-mellow\n- tin-utils\n- oakpress\n- perl-sundial"),
    ("list", "marked names", "* add libquartz 2.10.1\n* drop tin-utils 0.4.7\n* fix python-mellow 3.1.12\n* rename oakpress 1.0.9\n* bump perl-sundial 7.2.2"),
    ("list", "marked names", "• drop tin-utils 0.4.7\n• add oakpress-git 11.20.3\n• bump libquartz 9.3.1"),
    ("list", "numbered", "1. the manual\n2. the installer\n3. the output file\n4. the window\n5. the manual\n6. the old release"),
    ("list", "numbered", "(1) das Handbuch\n(2) die Ausgabe\n(3) der Neustart\n(4) das Fenster\n(5) die alte Fassung"),
    ("list", "numbered", "Step 1: la sortie\nStep 2: le manuel\nStep 3: la fenêtre\nStep 4: le journal\nStep 5: le manuel"),
    ("list", "numbered", "1) el manual\n2) la ventana\n3) el registro\n4) la salida\n5) el manual\n6) el programa"),
    ("list", "single item", "4. the output file"),
    ("list", "single item", "- [x] the installer"),
    ("list", "single item", "- python-mellow"),
    ("list", "boxes", "- [ ] the installer\n    - tin-utils\n- [x] the manual\n    - oakpress\n- [ ] the window\n    - libquartz-git"),
    ("list", "boxes", "- [x] le manuel\n    - python-mellow\n- [x] la fenêtre\n    - tin-utils\n- [ ] le journal\n    - oakpress"),
    ("list", "bare names", "libquartz-git\npython-mellow\ntin-utils\noakpress\nperl-sundial\nglasswing-bin\nmooring\nttf-harbour"),
    ("list", "bare names", "tin-utils oakpress libquartz-git mooring python-mellow perl-sundial glasswing-bin"),
    ("list", "run of names", "depends: libquartz>=2.10.1,tin-utils>=0.4.7,python-mellow>=3.1.12,oakpress>=1.0.9,mooring>=5.5.1"),
    ("list", "run of names", "libquartz-git>=2.10.1, tin-utils>=0.4.7, python-mellow>=3.1.12, oakpress>=1.0.9, mooring>=5.5.1"),
    ("list", "run of names", "provides = libquartz>=2.10.1; tin-utils>=0.4.7; python-mellow>=3.1.12; oakpress>=1.0.9"),
    ("list", "run of names", "conflicts with: oakpress>=1.0.9 | mooring>=5.5.1 | tin-utils>=0.4.7 | libquartz>=2.10.1"),
    ("list", "release notes", "3.10.2 (2022-05-14)\n  the manual: fixed\n  the installer: new\n  the window: #41\n  the output file: #7"),
    ("list", "release notes", "2.0.11 (2021-11-30)\n  das Handbuch: neu\n  die Ausgabe: #12\n  das Fenster: fixed\n  der Neustart: #88"),
    ("list", "heading", "## Overview"),
    ("list", "heading", "## Details"),
    ("table", "piped", "| package | version | bytes | state |\n| --- | --- | --- | --- |\n| oakpress | 1.0.9 | 55321 | ok |\n| tin-utils | 0.4.7 | 1290 | fail |"),
    ("table", "piped", "| a | b |\n| 4.3.1 | ok |"),
    ("table", "separated", "\"package\";\"version\";\"bytes\";\"state\"\n\"oakpress\";\"1.0.9\";\"55321\";\"ok\"\n\"tin-utils\";\"0.4.7\";\"1290\";\"fail\""),
    ("table", "separated", "package\tversion\tbytes\tstate\noakpress\t1.0.9\t55321\tok\ntin-utils\t0.4.7\t1290\tn/a\nmooring\t5.5.1\t8113\tfail"),
    ("table", "separated", "package               version               bytes\noakpress              1.0.9                 55321\ntin-utils             0.4.7                 1290"),
    ("table", "boxed", "+--------------------------------+\n│ oakpress │  1.0.9 │  55321 │ ok │\n│ tin-utils │  0.4.7 │   1290 │ n/a │\n│ mooring │  5.5.1 │  8113 │ fail │"),
    ("table", "listing", "-rw-r--r-- root root  55321 usr/share/oakpress/1.0.9\ndrwxr-xr-x root root   4096 usr/share/tin-utils/0.4.7\n-rwxr-xr-x root root   8113 usr/share/mooring/5.5.1"),
    ("table", "recipe", "pkgname=oakpress\npkgver=1.0.9\npkgrel=2\narch=('any')\nlicense=('MIT')\ndepends=('libquartz' 'mooring')\nsource=(\"$pkgname-$pkgver.tar.gz::https://files.example.org/oakpress/$pkgver.tar.gz\")\nsha256sums=('8c1f0a9ab5d7e3420c5b7d1e8f6a9b3c2d4e5f60718293a4b5c6d7e8f9a0b1c2')"),
    ("table", "recipe", "pkgname=tin-utils\npkgver=0.4.7\npkgrel=1\narch=('x86_64')\nlicense=('GPL')\nsource=(\"https://files.example.org/tin/$pkgver.tar.gz\")\nsha256sums=('0b3c2d4e5f60718293a4b5c6d7e8f9a0b1c28c1f0a9ab5d7e3420c5b7d1e8f6a')"),
    ("table", "commands", "build() {\n  cd \"$srcdir/$pkgname-$pkgver\"\n  ./configure --prefix=/usr --disable-docs\n  make -j4\n}"),
    ("table", "commands", "package() {\n  make DESTDIR=\"$pkgdir\" install\n  install -Dm644 COPYING \"$pkgdir/usr/share/licenses/oakpress/COPYING\"\n}"),
    ("table", "commands", "    make -j4\n    ./run-tests.sh"),
    ("table", "change", "--- a/PKGBUILD\n+++ b/PKGBUILD\n@@ -1,12 +1,12 @@\n pkgname=oakpress\n-pkgver=1.0.8\n+pkgver=1.0.9\n pkgrel=2\n arch=('any')\n-license=('GPL')\n+license=('MIT')"),
    ("table", "change", " build() {\n-  cd \"$srcdir/$pkgname-$pkgver\"\n+  cd \"$srcdir/$pkgname-$pkgver\"\n   ./configure --prefix=/usr\n-  make -j4\n+  make -j8\n }"),
    ("table", "fields", "pkgbase = oakpress\n\tdepends = libquartz\n\tdepends = mooring\n\tlicense = tin-utils\n\tmakedepends = python-mellow\n\tarch = glasswing-bin"),
    ("table", "log", "[  4711.204] cc: oakpress/main.c:120\n[  4712.880] ld: tin-utils/net.c:77\n[  4714.019] warn: mooring/io.c:342\n[  4715.666] note: libquartz/util.c:5"),
    ("table", "data", "{\"name\": \"oakpress\", \"version\": \"1.0.9\", \"files\": [{\"path\": \"usr/lib/oakpress/0.so\", \"size\": 55321}, {\"path\": \"usr/lib/oakpress/1.so\", \"size\": 8113}]}"),
    ("table", "data", "{\n  \"name\": \"tin-utils\",\n  \"version\": \"0.4.7\",\n  \"files\": [\n    {\n      \"path\": \"usr/lib/tin-utils/0.so\",\n      \"size\": 1290\n    }\n  ]\n}"),
    ("junk", "unreadable words", "xkrtd bvnm qwrtz plkjhg mnbv cxzs trwq ghjkl dfgh zxcvb nmkl rtwp sdfgh kjhgf bvcx qwrtp zzxcv hjklm"),
    ("junk", "digest", "8c1f0a9ab5d7e3420c5b7d1e8f6a9b3c2d4e5f60"),
    ("junk", "digest", "3f60718293a4b5c6d7e8f9a0b1c28c1f0a9ab5d7e3420c5b7d1e8f6a9b3c2d4e  a1b2c3d4e5\n718293a4b5c6d7e8f9a0b1c28c1f0a9ab5d7e3420c5b7d1e8f6a9b3c2d4e3f60  99c0ffee12"),
    ("junk", "escapes", "%3A%F1%9C%20%7B%E4%01%8D%6A%B2%55%C7%90%1F%EE%2B%73%A8%DC%04%69"),
    ("junk", "escapes", "\\x3a\\xf1\\x9c\\x20\\x7b\\xe4\\x01\\x8d\\x6a\\xb2\\x55\\xc7\\x90\\x1f\\xee\\x2b\\x73"),
    ("junk", "signs", "#+ @/~*:^}%=!;|<{&_?$[]>-~\\ *:/{}^%$#@!+=_-|<>?;& [~]{^}%#*@/+=:;|!<>"),
    ("junk", "repeats", "~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*~*"),
    ("junk", "repeats", "████████████████████████████████████████████████████████"),
    ("junk", "repeated words", "release release release release release release release release release release release release release release release release"),
    ("junk", "repeated words", "click here click here click here click here click here click here click here click here click here click here click here click here"),
    ("junk", "dump", "00000000: 3f60 7182 93a4 b5c6 d7e8 f9a0 b1c2 8c1f\n00000010: 0a9a b5d7 e342 0c5b 7d1e 8f6a 9b3c 2d4e\n00000020: 99c0 ffee 1271 8293 a4b5 c6d7 e8f9 a0b1"),
    ("junk", "long run", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("junk", "mangled", "Ã©Ð¾ â€™Ñ‚ ï»¿nÂ» Ã¶Ã¶Ñ‚Ñ‚ Ð¾â€™Â» eÃ¶ nï»¿ Ã¼â€™ Â»Â»Ã©e aâ€™Ð¾a Ñ‚eÃ¼ Ã¼Ã¶ Ã¼Ã¶enÃ¼Ã¼"),
    ("junk", "mangled", "��q�7?� ��?7q�� ?� ��7��q� �?� 7��q?�� ?7�� �q��"),
]
