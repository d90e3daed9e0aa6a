x420