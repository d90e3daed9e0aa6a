x527