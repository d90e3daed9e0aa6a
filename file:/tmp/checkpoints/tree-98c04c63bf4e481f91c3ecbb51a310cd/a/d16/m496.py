x496