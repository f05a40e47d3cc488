"""Licence notices as they are published, each with its label and its mandatory key phrases."""

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, key phrases, notice. A notice counts where all its key phrases stand; lower case, words only.
NOTICES = (
    ("gpl", ("gnu general public license",), "gnu general public license version 3"),
    ("gpl", ("gnu general public license",), "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("gpl", ("gnu gpl",), "gnu gpl version 3"),
    ("agpl", ("gnu affero general public license",), "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", ("gnu lesser general public license",), "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("apache", ("apache license",), "apache license version 2 0"),
    ("apache", ("apache license", "distributed on an as is basis"), "apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", ("mit license",), "mit license"),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "the above copyright notice and this permission notice shall be included"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"), "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", ("bsd license",), "bsd license"),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("isc", ("isc license",), "isc license"),
    ("mpl", ("mozilla public license",), "mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl", ("eclipse public license",), "eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("zlib", ("this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked"), "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", ("this is free and unencumbered software released into the public domain",), "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", ("creative commons zero",), "creative commons zero v1 0 universal"),
    ("cc0", ("cc0 1 0",), "cc0 1 0 universal public domain dedication"),
    ("cc-by", ("cc by",), "cc by 4 0"),
    ("cc-by", ("creative commons attribution",), "creative commons attribution 4 0 international license"),
    ("cc-by-sa", ("cc by sa",), "cc by sa 4 0"),
    ("cc-by-nc", ("cc by nc",), "cc by nc 4 0"),
)
