"""License templates with markup: <<beginOptional>> ... <<endOptional>> and <<var;match=...>>.

A var's match is either words that may stand there, alternatives parted by |, or a number of free words
as {least,most}. Wording outside the regions is mandatory, from the first word to the last: the licence texts
of MIT, ISC and BSD stand whole, as do the notices that Apache and GNU ask to be put into files, and the short
references ("licensed under ...") are templates of their own."""

WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;match=authors or copyright holders|{1,30}>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
    "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_ONE = "<<var;match=1|{0,1}>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
BSD_TWO = (
    "<<var;match=2|{0,1}>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution. "
)
BSD_THREE = (
    "<<var;match=3|{0,1}>> Neither the name of <<var;match=the copyright holder|{1,20}>> nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY <<var;match=the copyright holders and contributors|{1,20}>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=the copyright holder or contributors|{1,20}>> BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GNU_TAIL = (
    " of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;match=this program|{1,10}>> is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
GNU_HEAD = (
    "<<var;match=this program|{1,10}>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, <<beginOptional>>either<<endOptional>> version "
)
UNDER = "<<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>"

#: (label, template)
TEMPLATES = [
    ("mit", "<<var;match=released|licensed|distributed|available>> under " + UNDER + " MIT License"),
    ("mit", "<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;match={0,20}>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy "
     "of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. " + WARRANTY),
    ("apache-2.0", "Licensed under " + UNDER + " Apache License<<beginOptional>>, Version<<endOptional>> 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "<<var;match={0,12}>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0", "licensed under " + UNDER + " GNU General Public License<<beginOptional>>, version<<endOptional>> 2"),
    ("gpl-3.0", "licensed under " + UNDER + " GNU General Public License<<beginOptional>>, version<<endOptional>> 3"),
    ("gpl-2.0", GNU_HEAD + "2" + GNU_TAIL),
    ("gpl-3.0", GNU_HEAD + "3" + GNU_TAIL),
    ("cc-by-4.0", "licensed under " + UNDER + " <<beginOptional>>Creative Commons<<endOptional>> <<var;match=cc by|attribution>> 4.0"),
    ("cc-by-nc-4.0", "licensed under " + UNDER + " <<beginOptional>>Creative Commons<<endOptional>> <<var;match=cc by nc|attribution noncommercial>> 4.0"),
    ("cc-by-sa-4.0", "licensed under " + UNDER + " <<beginOptional>>Creative Commons<<endOptional>> <<var;match=cc by sa|attribution sharealike>> 4.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;match=the author|{1,20}>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
     "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=the author|{1,20}>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
     "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-2-clause", BSD_HEAD + BSD_ONE + BSD_TWO + BSD_TAIL),
    ("bsd-3-clause", BSD_HEAD + BSD_ONE + BSD_TWO + BSD_THREE + BSD_TAIL),
]
