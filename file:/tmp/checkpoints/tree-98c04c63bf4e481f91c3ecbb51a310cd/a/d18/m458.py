x458