x335