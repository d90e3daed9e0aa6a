x236