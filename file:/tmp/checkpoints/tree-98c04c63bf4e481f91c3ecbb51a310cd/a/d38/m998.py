x998