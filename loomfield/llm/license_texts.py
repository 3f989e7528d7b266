"""Public license texts and license notices as templates; case and punctuation don't count.

``[[ ... ]]`` is an optional region, ``{{n}}`` a replaceable one of at most n words (names, years, places).
"""

_BSD_OPEN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""
_BSD_ADVERTISING = """[[3.]] All advertising materials mentioning features or use of this software must display the following
    acknowledgement: This product includes software developed by {{20}}"""
_BSD_NAMES = """Neither the name of {{15}} nor the names of its contributors may be used to endorse or promote products derived from
    this software without specific prior written permission."""
_BSD_CLOSE = """THIS SOFTWARE IS PROVIDED BY {{20}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{20}} BE LIABLE
    FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
    ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
    WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so"""
_MIT_CLOSE = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{20}} BE LIABLE FOR
    ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_CLOSE = """THE SOFTWARE IS PROVIDED "AS IS" AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
    CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE."""

#: Whole license texts.
TEXTS = {
    "MIT": f"""{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice
        [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
        {_MIT_CLOSE}""",
    "MIT-0": f"{_MIT_GRANT}. {_MIT_CLOSE}",
    "NCSA": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal with the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: [[1.]] Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimers. [[2.]]
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimers in the documentation and/or other materials provided with the distribution. [[3.]] Neither the names of
        {{{{15}}}} nor the names of its contributors may be used to endorse or promote products derived from this Software
        without specific prior written permission. {_MIT_CLOSE.replace("IN NO EVENT SHALL", "IN NO EVENT SHALL [[THE CONTRIBUTORS OR]]").replace("OTHER DEALINGS IN", "OTHER DEALINGS WITH")}""",
    "ISC": f"""Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_CLOSE}""",
    "0BSD": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. {_ISC_CLOSE}""",
    "BSD-2-Clause": f"{_BSD_OPEN} {_BSD_CLOSE}",
    "BSD-3-Clause": f"{_BSD_OPEN} [[3.]] {_BSD_NAMES} {_BSD_CLOSE}",
    "BSD-4-Clause": f"{_BSD_OPEN} {_BSD_ADVERTISING} [[4.]] {_BSD_NAMES} {_BSD_CLOSE}",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. [[2.]] Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. [[3.]] This notice may not be removed or altered from any source
        distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
        is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
        including the above license grant, this restriction and the following disclaimer, must be included in all copies of the
        Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
        solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY
        DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        {_MIT_CLOSE}""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it
        is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING,
        DISTRIBUTION AND MODIFICATION [[0.]] You just DO WHAT THE FUCK YOU WANT TO.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without
        fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and
        the following two paragraphs appear in all copies. IN NO EVENT SHALL {{8}} BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT,
        SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS
        DOCUMENTATION, EVEN IF {{8}} HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. {{8}} SPECIFICALLY DISCLAIMS ANY
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND {{8}} HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE,
        SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.""",
    "HPND": """Permission to use, copy, modify [[and]] distribute this software and its documentation for any purpose [[and without
        fee]] is hereby granted [[without fee]], provided that the above copyright notice appear in all copies [[and]] that both
        that [[the]] copyright notice and this permission notice appear in supporting documentation""",
    "FSFAP": """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty
        provided the copyright notice and this notice are preserved. [[This file is offered as-is, without any warranty.]]""",
    "Fair": """Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that
        uses the works is notified of this instrument. DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.""",
    "Beerware": """wrote this file. As long as you retain this notice you can do whatever you want with this stuff. If we meet some
        day, and you think this stuff is worth it, you can buy me a beer in return""",
    "curl": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED""",
}

#: Notices that name a license whose text stands elsewhere.
NOTICES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {{6}} except in compliance with
        the License. You may obtain a copy of the License at {{10}} Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "Apache-notice": "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] Apache License [[Version]] [[2.0]]",
    "MIT-notice": "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] MIT License",
    "BSD-notice": "[[released]] [[distributed]] [[licensed]] under [[the]] [[terms of the]] [[2 clause]] [[3 clause]] [[new]] [[modified]] [[simplified]] BSD License",
    "GPL-2.0": """This program is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
    "GPL-2.0-only": """This program is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU General
        Public License version 2 as published by the Free Software Foundation.""",
    "GPL-3.0": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "LGPL-2.1": """This library is free software[[;]] you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version.""",
    "LGPL-3.0": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "AGPL-3.0": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "GPL-notice": "under the [[terms of the]] [[GNU]] [[Lesser]] [[Library]] [[Affero]] General Public License",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License {{2}} 2.0
        which is available at""",
    "EPL-1.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0
        which accompanies this distribution""",
    "CDDL": """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").
        You may not use this file except in compliance with the License.""",
    "CC0-1.0": """To the extent possible under law, {{12}} waived all copyright and related or neighboring rights to""",
    "CC-BY": "licensed under [[a]] [[the]] Creative Commons Attribution {{3}} International License",
    "CC-BY-SA": "licensed under [[a]] [[the]] Creative Commons Attribution ShareAlike {{3}} International License",
    "CC-BY-NC": "licensed under [[a]] [[the]] Creative Commons Attribution NonCommercial {{3}} International License",
    "Artistic-2.0": "under the [[terms of the]] [[the]] Artistic License [[(2.0)]] [[2.0]]",
    "SPDX": "SPDX License Identifier",
}
