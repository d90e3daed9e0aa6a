x378