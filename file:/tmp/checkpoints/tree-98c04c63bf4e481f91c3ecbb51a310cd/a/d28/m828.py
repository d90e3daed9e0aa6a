x828