x434